"""Keyed table changes as DataFrame to DataFrame functions, and catalogue maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import ratio
from cadenza.sources.shared import numbered, stored


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`table` and the rows whose key it does not have; of rows with one key the least."""
    value = F.struct(*[c for c in rows.columns if c not in key])
    once = rows.groupBy(*key).agg(F.min(value).alias("_v")).select(*key, "_v.*").select(rows.columns)
    return table.unionByName(once.join(table.select(key), key, "left_anti").select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows replace those of the same key; in `keep_old_if_null` a null keeps the old value. `rows` has each key once."""
    old, new = table.alias("o"), rows.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, key, "full")

    def value(c: str) -> Column:
        fresh = F.col(f"n.{c}")
        return F.when(F.col("_new"), F.coalesce(fresh, F.col(f"o.{c}")) if c in keep_old_if_null else fresh).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*key, *[value(c) for c in table.columns if c not in key]).select(table.columns)


def upsert_with_ids(table: DataFrame, rows: DataFrame, natural: list[str], id_column: str) -> DataFrame:
    """New natural keys get ids after the greatest one, in the order of their keys; known keys take over the new values."""
    known = table.select(*natural, id_column)
    fresh = rows.join(known, natural, "left")
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    added = numbered(fresh.where(F.col(id_column).isNull()), natural, "_n").crossJoin(F.broadcast(top))  # one row
    added = added.withColumn(id_column, (F.col("_top") + F.col("_n") + 1).cast(dict(table.dtypes)[id_column])).select(table.columns)
    return upsert(table, fresh.where(F.col(id_column).isNotNull()).select(table.columns).unionByName(added), [id_column])


def update_existing(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Null values of `changes` and changes of unknown keys do nothing."""
    changed = [c for c in changes.columns if c not in key]
    joined = table.alias("o").join(changes.alias("n"), key, "left")
    return joined.select(*key, *[(F.coalesce(f"n.{c}", f"o.{c}") if c in changed else F.col(f"o.{c}")).alias(c) for c in table.columns if c not in key]).select(table.columns)


def replace_groups(table: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """All rows of the groups in `rows` are replaced by these."""
    return table.join(rows.select(group).distinct(), group, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def delete_matching(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(table.columns)


def merge_mappings(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """(track_id, old_nav_id, nav_id): mappings of a batch that change something and take no id from a track that keeps it.

    A batch row is refused if another track holds its id, unless the batch moves that track to a different id.
    """
    moving = batch.join(catalog.select("track_id", F.col("nav_id").alias("old_nav_id")), "track_id")
    moving = moving.where(~F.col("nav_id").eqNullSafe(F.col("old_nav_id")))
    movers = moving.where("nav_id IS NOT NULL").select("track_id").distinct()
    holders = catalog.join(movers, "track_id", "left_anti").where("nav_id IS NOT NULL").select(F.col("track_id").alias("holder"), "nav_id")
    blocked = moving.join(holders, "nav_id").where("holder <> track_id").select("track_id").distinct()
    return moving.join(blocked, "track_id", "left_anti").select("track_id", "old_nav_id", "nav_id")


def quality_report(manifest: DataFrame, required: tuple[str, ...] = ("track_id", "title", "artist"), max_rate: float = 0.05) -> DataFrame:
    """One row: rows, repeats, missing required values, unmapped and quarantined tracks as counts and rates, and a status."""
    missing = F.greatest(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", 1).otherwise(0) for c in required])
    sums = manifest.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count("track_id") - F.count_distinct("track_id")).alias("n_repeated"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("n_missing"),
        F.count(F.when(F.col("nav_id").isNull(), 1)).alias("n_unmapped"),
        F.count(F.when(F.col("availability_status") == "quarantined", 1)).alias("n_quarantined"),
    )
    names = ("repeated", "missing", "unmapped", "quarantined")
    out = sums.select("*", *[ratio(F.col(f"n_{n}"), F.col("n_rows")).alias(f"{n}_rate") for n in names])
    notes = F.array_compact(F.array(*[F.when(F.col(f"{n}_rate") > max_rate, F.lit(f"{n}_high")) for n in names]))
    return out.withColumn("notes", F.array_join(notes, ",")).withColumn("status", F.when(F.col("notes") == "", "ok").otherwise("warning"))


def artist_relations(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """(media_id, artist, role): media files matched to tracks by file name or by title, once for either role.

    The condition is an OR: two equi-joins with the different artists of a path and of a title, united file by file.
    """
    artists = lambda key, name: tracks.select(key, "artist").distinct().groupBy(key).agg(F.transform(F.collect_list(F.struct("artist")), lambda x: x["artist"]).alias(name))
    found = files.join(artists("path", "by_name"), F.col("filename") == F.col("path"), "left").join(artists("track_key", "by_title"), F.col("title") == F.col("track_key"), "left")
    none = F.array().cast(f"array<{dict(tracks.dtypes)['artist']}>")
    found = found.select("media_id", F.array_union(F.coalesce("by_name", none), F.coalesce("by_title", none)).alias("artists")).where("size(artists) > 0")
    found = found.groupBy("media_id").agg(F.array_distinct(F.flatten(F.collect_list("artists"))).alias("artists"))
    found = found.select("media_id", F.explode("artists").alias("artist"))
    return found.withColumn("role", F.explode(F.array(F.lit("artist"), F.lit("albumartist"))))


def artist_stats(tracks: DataFrame) -> DataFrame:
    """(artist, n_tracks, n_albums, total_sec, first_track, as_json) by artist."""
    out = tracks.groupBy("artist").agg(
        F.count_distinct("track_id").alias("n_tracks"), F.count_distinct("album").alias("n_albums"), F.sum("duration_sec").alias("total_sec"), F.min("track_id").alias("first_track")
    )
    return out.withColumn("as_json", F.to_json(F.struct(F.col("n_albums").alias("albumCount"), F.col("n_tracks").alias("songCount"), F.col("total_sec").alias("size"))))


def filled_from_matches(table: DataFrame, matches: DataFrame, on: Column, columns: dict[str, str]) -> DataFrame:
    """`table` with `columns` (its own name: an expression over `matches`) filled from the one row of `matches` that it meets by `on`.

    Rows without a match stay as they are. `matches` must have one row for each row of `table` at most.
    """
    found = matches.select("_match", *[F.expr(source).alias(f"_new_{name}") for name, source in columns.items()])
    met = table.join(found, on, "left")
    return met.select([F.when(F.col("_match").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def updated_from_matches(spark: SparkSession, name: str, metadata: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table `name` of the session's catalogue, updated in those of `columns` that the catalogue says it has.

    `metadata` (filename, track_key, …) is met twice, by the table's path and then by its title (as the first match left it); the second
    overwrites the first. Of several rows with one key the least counts.
    """
    has = {c.name for c in spark.catalog.listColumns(name)}
    present = {c: source for c, source in columns.items() if c in has}
    table = spark.table(name)
    for key, own in (("filename", "path"), ("track_key", "title")):
        if own in has and present:
            once = metadata.groupBy(key).agg(F.min(F.struct(*[c for c in metadata.columns if c != key])).alias("_m")).select(F.col(key).alias("_match"), "_m.*")
            table = filled_from_matches(table, once, F.col("_match") == F.col(own), present)
    return table


def track_records(catalog: DataFrame, width: int = 12) -> DataFrame:
    """(track_id, record): each track as the JSON object of the interface; titles over `width` characters end in an ellipsis."""
    title = F.when(F.char_length("title") > width, F.concat(F.substring("title", 1, width - 1), F.lit("…"))).otherwise(F.col("title"))
    playable = F.col("is_playable") & (F.col("availability_status") == "available")
    record = F.struct(F.col("track_id").cast("string").alias("track_id"), title.alias("title"), "artist", playable.alias("playable"))
    return catalog.select("track_id", F.to_json(record).alias("record"))


def where_given(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """`rows` that have the wanted values; a column whose wanted value is None does not matter."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def first_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows of the `most` smallest keys."""
    keys = rows.select(key).distinct().orderBy(key).limit(most)
    return rows.join(keys, key, "left_semi")


def activations(events: DataFrame) -> DataFrame:
    """(model_version, activated_at, deactivated_at, parent, status): each activation ends the one before."""
    steps = stored(numbered(events.select("model_version", "activated_at"), ["activated_at", "model_version"], "_n"), "activations")
    after = steps.select((F.col("_n") - 1).alias("_n"), F.col("activated_at").alias("deactivated_at"))
    before = steps.select((F.col("_n") + 1).alias("_n"), F.col("model_version").alias("before"))
    steps = steps.join(after, "_n", "left").join(before, "_n", "left")
    parent = F.when(F.col("before") != F.col("model_version"), F.col("before"))
    status = F.when(F.col("deactivated_at").isNull(), "active").otherwise("previous")
    return steps.select("model_version", "activated_at", "deactivated_at", parent.alias("parent"), status.alias("status"))
