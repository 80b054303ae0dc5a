from cadenza.operators import monitoring


def test_failures_and_fallbacks_of_codes_and_levels(spark):
    rows = [
        ("m", None, "", "", "", 10.0, 4),
        ("m", False, "E1", None, None, 20.0, 4),
        ("m", True, "", "healthy", "none", 30.0, None),
        ("m", False, None, "healthy", "popular", 40.0, 2),
        ("m", False, None, "catalog_insufficient", "none", None, 2),
    ]
    names = "model string, pipeline_error boolean, error_code string, fallback_state string, fallback_level string, total_latency_ms double, returned_count int"
    got = monitoring.request_rollup(spark.createDataFrame(rows, names), ["model"]).first()
    assert (got.request_count, got.error_rate, got.fallback_rate, got.catalog_failure_count) == (5, 0.4, 0.4, 1)
    assert (got.avg_returned_count, got.p50_latency_ms, got.p95_latency_ms, got.sample_status) == (2.4, 20.0, 40.0, "insufficient")
