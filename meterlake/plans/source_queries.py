"""Readers and the extraction of fields, over documents made of the tables' rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import usage
from ..sources import binary, files, generic, routers
from ..tables import shared_dir
from .adapter import table
from .queries import query

_U, _K = "CAST(user_id AS STRING)", "get_json_object(props, '$.k')"
_FORMS = [
    f"'{{\"input_tokens\": ' || {_U} || ', \"output_tokens\": ' || {_K} || ', \"cache_read_input_tokens\": 2, \"cache_creation_input_tokens\": 1, \"model\": \"openai/gpt-4.1\", \"timestamp\": ' || CAST(1700000000 + event_id AS STRING) || '}}'",
    f"'{{\"usage\": {{\"prompt_tokens\": ' || {_U} || ', \"completion_tokens\": ' || {_K} || '}}, \"message\": {{\"model\": \"kimi-k3 (x)\"}}, \"ts\": ' || CAST(1700000000000 + event_id AS STRING) || '}}'",
    f"'{{\"metadata\": {{\"metrics\": {{\"input_tokens\": ' || {_U} || ', \"output_tokens\": ' || {_K} || ', \"cache_read_tokens\": 50}}}}, \"model\": 7, \"modelId\": \"m|p\", \"created_at\": \"2024-01-05T10:00:00Z\"}}'",
    f"'{{\"cached_tokens\": ' || {_U} || ', \"prompt_tokens_details\": {{\"cached_tokens\": 400}}, \"input\": \"' || {_K} || '\", \"timestamp\": \"never\", \"time\": {{\"created\": \"2024-02-01T00:00:00+07:00\"}}}}'",
    f"'{{\"prompt_tokens\": \"abc\", \"input\": 5, \"output\": 1, \"prompt_tokens_details\": {{\"cached_tokens\": ' || {_U} || '}}, \"timestamp\": null}}'",
    "'{broken'",
]
_FORM = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"
_KS = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
#: What the documents hold, worked out from the rows that they are made of.
_FIELDS = f"""fields AS (SELECT event_id, CASE event_id % 6 WHEN 3 THEN {_KS} WHEN 4 THEN 0 ELSE user_id END AS i, CASE event_id % 6 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE {_KS} END AS o,
CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 50 ELSE user_id END AS r, CASE event_id % 6 WHEN 0 THEN 1 ELSE 0 END AS w, CASE event_id % 6 WHEN 0 THEN 'gpt-4.1' WHEN 1 THEN 'kimi-k3' WHEN 2 THEN 'm' END AS model,
CASE event_id % 6 WHEN 0 THEN make_timestamp((1700000000 + event_id) * 1000000) WHEN 1 THEN make_timestamp((1700000000000 + event_id) * 1000) WHEN 2 THEN TIMESTAMP '2024-01-05 10:00:00' WHEN 3 THEN TIMESTAMP '2024-01-31 17:00:00' END AS ts FROM events WHERE event_id % 6 <> 5)"""


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_FORM).alias("value"))


@query(f"WITH {_FIELDS} SELECT event_id, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(r AS BIGINT) AS cache_read_tokens, CAST(w AS BIGINT) AS cache_write_tokens FROM fields WHERE i + o + r + w > 0")
def extract_buckets(spark, sf_dir):
    out = usage.with_buckets(_rows(spark, sf_dir).withColumn("v", F.try_parse_json("value")), F.col("v"))
    return out.select("event_id", *[F.col(f"b.{x}").alias(f"{x}_tokens") for x in ("input", "output", "cache_read", "cache_write")])


@query(f"WITH {_FIELDS} SELECT event_id, model FROM fields")
def extract_model(spark, sf_dir):
    v = F.col("v")
    return _rows(spark, sf_dir).withColumn("v", F.try_parse_json("value")).filter("v is not null").select("event_id", usage.model_of(v, F.try_variant_get(v, "$.message", "variant")).alias("model"))


@query(f"WITH {_FIELDS} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM fields")
def extract_timestamp(spark, sf_dir):
    v = F.col("v")
    return _rows(spark, sf_dir).withColumn("v", F.try_parse_json("value")).filter("v is not null").select("event_id", F.date_format(usage.time_of(v), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def _written(rows, spark, kind: str) -> str:
    """A folder in the shared place with the rows' one text column as files."""
    path = f"{shared_dir(spark)}/made/{kind}-{uuid.uuid4().hex}"
    rows.write.text(path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name[:-4]}.{kind}"))
    return path


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN event_id % 6 = 5 THEN 0 ELSE 1 END) AS BIGINT) AS parsed FROM events")
def src_jsonl_scan(spark, sf_dir):
    lines = files.read_lines(spark, [_written(_rows(spark, sf_dir).select("value"), spark, "jsonl")])
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count(F.try_parse_json("value")).alias("parsed"))


@query("SELECT user_id, event_type AS kind FROM events")
def src_json_explode(spark, sf_dir):
    """One document for each user, in the three shapes that have rows."""
    row = F.to_json(F.struct("user_id", "event_type"))
    docs = table(spark, sf_dir, "events").withColumn("row", row).groupBy("user_id").agg(F.concat_ws(",", F.collect_list("row")).alias("rows"))
    whole = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("["), "rows", F.lit("]"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"messages": ['), "rows", F.lit("]}"))).otherwise(F.concat(F.lit('{"messages": 1, "usage": ['), "rows", F.lit("]}")))
    found = files.explode_documents(docs.select(F.lit("p").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), whole.alias("value")))
    return found.select(usage.get(F.col("row"), "user_id", "long").alias("user_id"), usage.get(F.col("row"), "event_type").alias("kind"))


@query(f"WITH {_FIELDS} SELECT CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(r AS BIGINT) AS cache_read_tokens, CAST(w AS BIGINT) AS cache_write_tokens, model FROM fields WHERE i + o + r + w > 0")
def generic_usage_scan(spark, sf_dir):
    path = _written(_rows(spark, sf_dir).select("value"), spark, "jsonl")
    return generic.read_usage(spark, [path], "amp").select("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "model")


@query(f"""SELECT event_id, user_id AS input_tokens, {_KS} AS output_tokens, CASE WHEN event_id % 2 = 0 THEN CAST(3 AS BIGINT) ELSE 0 END AS cache_read_tokens, CASE WHEN event_id % 3 = 0 THEN 'provider:acme' END AS workspace, CASE WHEN event_id % 5 = 0 THEN value END AS router_cost, CAST(greatest(1, event_id % 4) AS BIGINT) AS request_count
FROM events WHERE event_id % 7 <> 0 AND (user_id + {_KS} + CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END > 0 OR (event_id % 5 = 0 AND event_id % 4 > 0))""")  # fmt: skip
def router_rows(spark, sf_dir):
    """Request rows of a router, with the costs that they state, 0 included; every seventh has no time and is left out."""
    e = table(spark, sf_dir, "events")
    when = lambda cond, c: F.when(F.expr(cond), c)
    inner = F.to_json(F.struct(F.col("user_id").alias("prompt_tokens"), when("event_id % 2 = 0", F.struct(F.lit(3).alias("cached_tokens"))).alias("prompt_tokens_details")))
    row = F.struct(F.col("event_id").alias("id"), when("event_id % 7 <> 0", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("timestamp"), F.get_json_object("props", "$.k").alias("completionTokens"), inner.alias("tokens"), when("event_id % 3 = 0", F.lit("acme")).alias("provider"), when("event_id % 5 = 0", F.col("value")).alias("cost"), (F.col("event_id") % 4).alias("requests"))
    docs = e.select(F.lit("p").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(1).cast("long").alias("line_no"), F.parse_json(F.to_json(row)).alias("row"))
    out = routers.request_rows(docs, "9router", free=True)
    return out.select(F.col("native_id").cast("long").alias("event_id"), "input_tokens", "output_tokens", "cache_read_tokens", "workspace", "router_cost", "request_count")


@query("SELECT doc_id, sha256(text) AS digest, true AS same FROM documents WHERE text IS NOT NULL")
def aes_gcm_roundtrip(spark, sf_dir):
    """Texts encrypted as session files are, and read back."""
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("content", F.aes_encrypt(F.col("text").cast("binary"), key, F.lit("GCM")))
    back = docs.withColumn("plain", binary.decrypt(F.col("content"), key))
    return back.select("doc_id", F.sha2("plain", 256).alias("digest"), (F.col("plain") == F.col("text").cast("binary")).alias("same"))
