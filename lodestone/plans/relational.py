"""Queries over catalog, payload and stream tables: joins, groups, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import sampling as S
from lodestone.functions import text as T
from lodestone.operators import catalog, folds, ranges, synth
from lodestone.plans.record import query
from lodestone.session import table

DRAW = "cast('0x' || substr(md5('s42|{name}|' || {key}), 1, 8) as bigint)"


def duck_draw(name: str, key: str = "p_partkey") -> str:
    return DRAW.format(name=name, key=key)


@query("equality_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def equality_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("distinct_counts", "SELECT count(*) AS n, count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands FROM part")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("names"), F.count_distinct("p_brand").alias("brands"))


@query("partial_final_count", "SELECT coalesce(l_returnflag, 'total') AS flag, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def partial_final_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("total")).alias("flag"), "n")


def _users(spark: SparkSession, d: str, event_type: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == event_type)


@query("removed_ids_except", "SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'click' AND value > 50")
def removed_ids_except(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d, "view").select("user_id").subtract(_users(spark, d, "click").where("value > 50").select("user_id"))


@query("kept_ids_intersect", "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click'")
def kept_ids_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d, "view").select("user_id").intersect(_users(spark, d, "click").select("user_id"))


@query("union_all_pairs", "SELECT side, label, count(*) AS n FROM (SELECT 'x' AS side, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'x2' AS side, label FROM embeddings WHERE vec_id % 2 = 1) u GROUP BY side, label")
def union_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings")
    side = lambda rest, name: points.where(F.col("vec_id") % 2 == rest).select(F.lit(name).alias("side"), "label")
    return side(0, "x").unionByName(side(1, "x2")).groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"))


@query("ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def ordered_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("global_topk", "SELECT rank, o_orderkey, o_totalprice FROM (SELECT cast(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rank, o_orderkey, o_totalprice FROM orders) r WHERE rank <= 20")
def global_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best rows come together from each partition's best; only those are ranked, in one array of 20."""
    best = table(spark, d, "orders").select("o_totalprice", "o_orderkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("order"), "o_orderkey", "o_totalprice"))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("i", "r")).select((F.col("i") + 1).cast("long").alias("rank"), "r.o_orderkey", "r.o_totalprice")


@query("rate_metrics", "SELECT event_id, round(cast(length(props) AS double) / nullif(value, 0) / 1000, 6) AS kbps, round(value * 1000, 6) AS ms, round(1000 / nullif(value, 0), 6) AS fps FROM events")
def rate_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of a message of so many bytes after so many seconds; no rate for a period of 0."""
    period = F.nullif(F.col("value"), F.lit(0.0))
    kbps, fps = F.length("props").cast("double") / period / 1000, F.lit(1000.0) / period
    return table(spark, d, "events").select("event_id", F.round(kbps, 6).alias("kbps"), F.round(F.col("value") * 1000, 6).alias("ms"), F.round(fps, 6).alias("fps"))


@query("adaptive_delay", "SELECT event_id, round(greatest(cast(66 AS double), coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 1000 END, 0.01) * 1500), 6) AS delay_ms FROM events")
def adaptive_delay(spark: SparkSession, d: str) -> DataFrame:
    """The frame period in ms, or half as much again as the last processing took (10 ms where that is unknown)."""
    took = F.when(F.col("event_id") % 4 != 0, F.col("value") / 1000)
    return table(spark, d, "events").select("event_id", F.round(F.greatest(F.lit(66.0), F.coalesce(took, F.lit(0.01)) * 1500), 6).alias("delay_ms"))


@query("value_range_check", "SELECT event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, min(value) >= 0 AND max(value) <= 1 AS in_range FROM events GROUP BY event_type")
def value_range_check(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), ((F.col("low") >= 0) & (F.col("high") <= 1)).alias("in_range"))


@query("current_frame_tracks", "SELECT DISTINCT user_id FROM events WHERE cast(ts AS date) = (SELECT max(cast(ts AS date)) FROM events)")
def current_frame_tracks(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    last = F.broadcast(days.agg(F.max("day").alias("day")))  # one row
    return days.join(last, "day", "left_semi").select("user_id").distinct()


@query("anti_join_missing", "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("upsert_merge", "SELECT vec_id, CASE WHEN vec_id >= 250 THEN label + 100 ELSE label END::BIGINT AS label FROM embeddings")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return catalog.upserted(points.where("vec_id < 300"), points.where("vec_id >= 250").withColumn("label", F.col("label") + 100), "vec_id")


_LABEL_JSON = "concat('{\"quality\":', cast(quality AS string), '}')"


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.expr(_LABEL_JSON).alias("payload"))


_DUCK_PAYLOAD = "'{\"quality\":' || quality::VARCHAR || '}'"


@query("payload_overwrite", f"SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN {_DUCK_PAYLOAD} ELSE lang END AS payload FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def payload_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return catalog.overwritten(table(spark, d, "documents").select("doc_id", F.col("lang").alias("payload")), _payloads(spark, d), "doc_id", "payload")


@query("payload_fill", f"SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, {_DUCK_PAYLOAD}) AS payload FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def payload_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("held"))
    return docs.join(_payloads(spark, d), "doc_id", "left").select("doc_id", F.coalesce("held", "payload").alias("payload"))


@query("group_by_name", "SELECT p_name, count(*) AS n, min(p_partkey) AS min_id, max(p_partkey) AS max_id FROM part GROUP BY p_name")
def group_by_name(spark: SparkSession, d: str) -> DataFrame:
    return catalog.grouped(table(spark, d, "part"), "p_name", "p_partkey")


@query("group_by_set", "SELECT p_brand, count(*) AS n, min(p_partkey) AS min_id, max(p_partkey) AS max_id FROM part GROUP BY p_brand")
def group_by_set(spark: SparkSession, d: str) -> DataFrame:
    return catalog.grouped(table(spark, d, "part"), "p_brand", "p_partkey")


@query("dense_label_encode", "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS type_idx FROM events")
def dense_label_encode(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_dense_labels(table(spark, d, "events").select("event_id", "event_type"), {"event_type": "type_idx"}).select("event_id", "type_idx")


@query("label_triple", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_partkey) - 1)::BIGINT AS id_idx, (dense_rank() OVER (ORDER BY p_name) - 1)::BIGINT AS name_idx, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS set_idx FROM part")
def label_triple(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return catalog.with_dense_labels(part, {"p_partkey": "id_idx", "p_name": "name_idx", "p_brand": "set_idx"}).select("p_partkey", "id_idx", "name_idx", "set_idx")


@query("last_wins_dedup", "SELECT o_custkey, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.last_by(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def _ring(by: str) -> str:
    return f"""SELECT p_partkey, {by}, nullif(coalesce(lead(p_partkey) OVER w, first(p_partkey) OVER w), p_partkey) AS other_id
        FROM part WINDOW w AS (PARTITION BY {by} ORDER BY {duck_draw('similar')}, p_partkey)"""


@query("hard_negative_pairs", _ring("p_name"))
def hard_negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.similar(table(spark, d, "part"), "p_partkey", "p_name", S.draw("similar", F.col("p_partkey")))


@query("similar_by_set", _ring("p_brand"))
def similar_by_set(spark: SparkSession, d: str) -> DataFrame:
    return catalog.similar(table(spark, d, "part"), "p_partkey", "p_brand", S.draw("similar", F.col("p_partkey")))


@query("pair_batch", f"SELECT p_partkey, CASE WHEN {duck_draw('negative')} < 858993459 AND other_id IS NOT NULL THEN other_id ELSE p_partkey END AS pair_id, NOT ({duck_draw('negative')} < 858993459 AND other_id IS NOT NULL) AS same_id FROM ({_ring('p_name')}) t")
def pair_batch(spark: SparkSession, d: str) -> DataFrame:
    pairs = hard_negative_pairs(spark, d)
    swap = (S.draw("negative", F.col("p_partkey")) < 858993459) & F.col("other_id").isNotNull()
    return pairs.select("p_partkey", F.when(swap, F.col("other_id")).otherwise(F.col("p_partkey")).alias("pair_id"), (~swap).alias("same_id"))


@query("total_price", """SELECT event_type, round(coalesce(sum(try_cast(p AS double)), 0), 2) AS total FROM (SELECT event_type, CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE value::DECIMAL(18,2)::VARCHAR END AS p FROM events) t GROUP BY event_type""")
def total_price(spark: SparkSession, d: str) -> DataFrame:
    price = F.expr("case event_id % 10 when 0 then null when 1 then '' when 2 then 'n/a' else cast(cast(value as decimal(18,2)) as string) end")
    return table(spark, d, "events").select("event_type", price.alias("p")).groupBy("event_type").agg(F.round(F.coalesce(F.sum(F.expr("try_cast(p as double)")), F.lit(0.0)), 2).alias("total"))


@query("sum_payload_bytes", "SELECT lang, coalesce(sum(length(base64(encode(text)))), 0)::BIGINT AS n_bytes FROM documents GROUP BY lang")
def sum_payload_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.coalesce(F.sum(F.length(T.base64_text(F.col("text").cast("binary")))), F.lit(0)).alias("n_bytes"))


@query("base64_encode", "SELECT doc_id, md5(base64(encode(text))) AS encoded_md5 FROM documents")
def base64_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.base64_text(F.col("text").cast("binary")).cast("binary")).alias("encoded_md5"))


@query("ewma_fold", """WITH RECURSIVE r AS (SELECT conv_id, cast(length(text) AS double) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
    f AS (SELECT conv_id, k, v AS z FROM r WHERE k = 1 UNION ALL SELECT f.conv_id, r.k, CASE WHEN f.z IS NULL OR f.z = 0 THEN r.v ELSE r.v * 0.1::DOUBLE + f.z * 0.9::DOUBLE END FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
    SELECT conv_id, round(arg_max(z, k), 6) AS ewma FROM f GROUP BY conv_id""")
def ewma_fold(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("v"))
    return folds.ewma(turns, "conv_id", ["turn", "v"], "v").select("conv_id", F.round("z", 6).alias("ewma"))


@query("gated_ewma", """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS us, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, k, us AS t, v AS z, 1::BIGINT AS n FROM r WHERE k = 1
          UNION ALL SELECT f.user_id, r.k, CASE WHEN r.us - f.t > 43200000000 THEN r.us ELSE f.t END, CASE WHEN r.us - f.t > 43200000000 THEN 0.1::DOUBLE * r.v + 0.9::DOUBLE * f.z ELSE f.z END, f.n + CASE WHEN r.us - f.t > 43200000000 THEN 1 ELSE 0 END
          FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
    SELECT user_id, round(arg_max(z, k), 6) AS z, max(n)::BIGINT AS n FROM f GROUP BY user_id""")
def gated_ewma(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    return folds.gated_ewma(events, "user_id", "us", "value", 12 * 3600 * 1e6, ties=("event_id",)).select("user_id", F.round("z", 6).alias("z"), "n")


@query("every_n_gate", """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, k, event_id AS t, 1::BIGINT AS n FROM r WHERE k = 1 UNION ALL SELECT f.user_id, r.k, CASE WHEN r.event_id - f.t >= 500 THEN r.event_id ELSE f.t END, f.n + CASE WHEN r.event_id - f.t >= 500 THEN 1 ELSE 0 END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
    SELECT user_id, max(n)::BIGINT AS emitted FROM f GROUP BY user_id""")
def every_n_gate(spark: SparkSession, d: str) -> DataFrame:
    return folds.every_n(table(spark, d, "events"), "user_id", "event_id", 500)


@query("frame_period_lag", "SELECT event_id, epoch_us(lag(ts, 1) OVER w) - epoch_us(lag(ts, 2) OVER w) AS period_us FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def frame_period_lag(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = ranges.lagged(events, "event_type", ["us", "event_id"], {"ended": ("us", 1), "began": ("us", 2)})
    return rows.select("event_id", (F.col("ended") - F.col("began")).alias("period_us"))


@query("frame_diff", """WITH p AS (SELECT DISTINCT user_id, cast(ts AS date) AS day FROM events), b AS (SELECT max(day) AS last FROM p),
    cur AS (SELECT user_id FROM p, b WHERE day = last), pre AS (SELECT user_id FROM p, b WHERE day = last - 1)
    SELECT coalesce(cur.user_id, pre.user_id) AS user_id, CASE WHEN pre.user_id IS NULL THEN 'new' WHEN cur.user_id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM cur FULL JOIN pre ON cur.user_id = pre.user_id""")
def frame_diff(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    last = days.agg(F.max("day").alias("last"))
    near = days.join(F.broadcast(last), F.col("day") >= F.date_sub("last", 1)).groupBy("user_id").agg(F.max((F.col("day") == F.col("last")).cast("int")).alias("now"), F.max((F.col("day") < F.col("last")).cast("int")).alias("before"))
    return near.select("user_id", F.when(F.col("before") == 0, "new").when(F.col("now") == 0, "removed").otherwise("kept").alias("status"))


@query("selection_rule", """WITH p AS (SELECT event_type, user_id FROM events), s AS (SELECT event_type, min(user_id) AS first_id, max(CASE WHEN user_id = 7 THEN user_id END) AS kept FROM p GROUP BY event_type)
    SELECT event_type, coalesce(kept, first_id) AS selected, nullif(first_id, coalesce(kept, first_id)) AS toggled FROM s""")
def selection_rule(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "events").groupBy("event_type").agg(F.min("user_id").alias("first_id"), F.max(F.when(F.col("user_id") == 7, F.col("user_id"))).alias("kept"))
    selected = F.coalesce("kept", "first_id")
    return held.select("event_type", selected.alias("selected"), F.nullif(F.col("first_id"), selected).alias("toggled"))


@query("nearest_assignment", """WITH e AS (SELECT event_type, event_id, value, cast(ts AS date) AS day FROM events), d AS (SELECT max(day) AS last FROM e),
    det AS (SELECT e.* FROM e, d WHERE day = last), trk AS (SELECT e.* FROM e, d WHERE day = last - 1),
    c AS (SELECT det.event_id, trk.event_id AS track_id, abs(det.value - trk.value) AS distance, row_number() OVER (PARTITION BY det.event_id ORDER BY abs(det.value - trk.value), trk.event_id) AS k
          FROM det JOIN trk ON det.event_type = trk.event_type AND abs(det.value - trk.value) <= 5)
    SELECT event_id, track_id, round(distance, 6) AS distance FROM c WHERE k = 1""")
def nearest_assignment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value", F.to_date("ts").alias("day"))
    last = F.broadcast(e.agg(F.max("day").alias("last")))
    det, trk = e.join(last, F.col("day") == F.col("last")), e.join(last, F.col("day") == F.date_sub("last", 1))
    return ranges.nearest(det, trk, "event_type", "event_id", "value", 5.0).select("event_id", F.col("other").alias("track_id"), F.round("distance", 6).alias("distance"))


@query("symbol_tokenize_join", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '\{[^{}]*\}')) AS token FROM pages), d AS (SELECT token FROM t GROUP BY token ORDER BY count(*) DESC, token LIMIT 20)
    SELECT t.page_id, count(d.token) AS known, count(*) - count(d.token) AS unknown FROM t LEFT JOIN d ON t.token = d.token GROUP BY t.page_id""")
def symbol_tokenize_join(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "pages").select("page_id", F.explode(T.symbols(F.col("html"))).alias("token"))
    known = tokens.groupBy("token").count().orderBy(F.col("count").desc(), "token").limit(20).select("token", F.lit(1).alias("one"))
    return tokens.join(F.broadcast(known), "token", "left").groupBy("page_id").agg(F.count("one").alias("known"), (F.count(F.lit(1)) - F.count("one")).alias("unknown"))


@query("track_color_hash", "SELECT DISTINCT user_id, '#' || right(sha256(user_id::VARCHAR), 6) AS color FROM events")
def track_color_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().withColumn("color", T.color_of(F.col("user_id")))


@query("zero_pad_name", "SELECT p_partkey, printf('image_%04d', p_partkey) AS name FROM part")
def zero_pad_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.numbered("image", F.col("p_partkey")).alias("name"))


@query("timestamp_format", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"))


@query("concat_non_null", "SELECT p_partkey, concat_ws('_', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR END) AS name FROM part")
def concat_non_null(spark: SparkSession, d: str) -> DataFrame:
    even, third = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.joined_known("_", even, F.col("p_type"), third).alias("name"))


@query("payload_json_extract", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def payload_json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("js_round", "SELECT event_id, floor(value * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS rounded FROM events")
def js_round(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.js_round(F.col("value"), 1).alias("rounded"))


@query("batch_assign", "SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 32)::BIGINT AS batch FROM part")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    ids = catalog.dense_index(table(spark, d, "part"), "p_partkey", "i")
    return ids.select("p_partkey", F.floor(F.col("i") / 32).alias("batch"))


@query("batch_collect", "SELECT batch, count(*) AS n, min(p_partkey) AS low, max(p_partkey) AS high FROM (SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 32)::BIGINT AS batch FROM part) t GROUP BY batch")
def batch_collect(spark: SparkSession, d: str) -> DataFrame:
    return batch_assign(spark, d).groupBy("batch").agg(F.sort_array(F.collect_list("p_partkey")).alias("ids")).select("batch", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("low"), F.array_max("ids").alias("high"))


def _duck_split(name: str) -> str:
    return f"SELECT '{name}' AS split, p_partkey FROM part QUALIFY row_number() OVER (ORDER BY {duck_draw('split_' + name)}, p_partkey) <= (SELECT floor(count(*) * 0.1::DOUBLE) FROM part)"


_DUCK_SPLITS = f"SELECT 'train' AS split, p_partkey FROM part UNION ALL ({_duck_split('val')}) UNION ALL ({_duck_split('test')})"


@query("split_members", _DUCK_SPLITS)
def split_members(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a train sample; a tenth of them gives further ones for validation, another tenth for testing."""
    return synth.splits_of(table(spark, d, "part"), "p_partkey", 0.1, 0.1)


@query("split_counts", f"SELECT split, count(*) AS n FROM ({_DUCK_SPLITS}) t GROUP BY split")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_members(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("sorted_ids", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey))::BIGINT AS rank FROM part")
def sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dense_index(table(spark, d, "part"), "p_partkey", "i").select("p_partkey", (F.col("i") + 1).alias("rank"))


@query("indexed_scan", "SELECT url, (row_number() OVER (ORDER BY url) - 1)::BIGINT AS idx FROM (SELECT DISTINCT url FROM pages) t")
def indexed_scan(spark: SparkSession, d: str) -> DataFrame:
    return catalog.dense_index(table(spark, d, "pages"), "url", "idx")


@query("reverse_order", "SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC, role DESC) AS roles FROM conversations GROUP BY conv_id")
def reverse_order(spark: SparkSession, d: str) -> DataFrame:
    # the result is one string a conversation, so its rows meet in any case
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role")), asc=False).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["role"]), ",").alias("roles"))


@query("scan_filter_extension")
def scan_filter_extension(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.sources.files import files_with_extension

    return files_with_extension(spark, d, [".parquet"]).select("path", "length")


@query("tumbling_count", "SELECT time_bucket(interval '1 day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
def tumbling_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


@query("sliding_count", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval '6 hours']) AS s FROM events) t GROUP BY s")
def sliding_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("session_count", "SELECT user_id, sum(fresh)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval '12 hours' THEN 0 ELSE 1 END AS fresh FROM events) t GROUP BY user_id")
def session_count(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "events").groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
