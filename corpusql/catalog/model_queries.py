"""C: batch model calls and response parsing.

Replies are made from the orders: clean, fenced, wrapped in chatter, a bare
list, broken in a repairable way, and not JSON at all.
"""

from pyspark.sql import functions as F

from corpusql.catalog.base import CHUNKS_SQL, chunks, load, orders, query
from corpusql.functions import modeljson as mj
from corpusql.operators import model
from corpusql.session import shared_dir

REPLY_TYPES = {"status": "TEXT", "total": "REAL"}


def order_replies(spark, d):
    rest = F.col("o_orderkey") % 6
    attributes = F.concat(
        F.lit('{"attributes":{"status":"'), F.col("o_orderstatus"), F.lit('","total":"'),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('"},"confidence":0.9}'),
    )
    body = F.concat(F.lit('{"entities":['), attributes, F.lit("]}"))
    second = F.lit(',{"attributes":{"status":"second","total":null},"confidence":0.7},{"attributes":{"status":"weak"}}')
    content = (
        F.when(rest == 0, body)
        .when(rest == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(rest == 2, F.concat(F.lit("Here it is: "), body, F.lit(" That is all.")))
        .when(rest == 3, F.concat(F.lit("["), attributes, second, F.lit("]")))
        .when(rest == 4, F.concat(F.lit('{"entities":['), attributes, F.lit(",],}")))
        .otherwise(F.lit("Sorry, I cannot do that."))
    )
    return orders(spark, d).select("o_orderkey", "o_orderstatus", content.alias("content"))


BODY_SQL = """'{"attributes":{"status":"' || o_orderstatus || '","total":"' || o_totalprice::DECIMAL(18,2)::VARCHAR
  || '"},"confidence":0.9}'"""


@query("parse_model_json", f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 2 END AS repair_level,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 3 THEN '[' || {BODY_SQL} ||
   ',{{"attributes":{{"status":"second","total":null}},"confidence":0.7}},{{"attributes":{{"status":"weak"}}}}]'
  ELSE '{{"entities":[' || {BODY_SQL} || ']}}' END AS json FROM orders
""")
def parse_model_json(spark, d):
    parsed = mj.parse_reply(F.col("content"))
    return order_replies(spark, d).select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.json", "p.repair_level")


@query("repair_model_json", """
SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey::VARCHAR AS k FROM orders
""")
def repair_model_json(spark, d):
    """Every kind of damage the repair knows, on the values of the orders."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    k = F.col("o_orderkey").cast("string")
    rest = F.col("o_orderkey") % 5
    raw = (
        F.when(rest == 0, F.concat(F.lit("{'status':'"), status, F.lit("','priority':'"), priority, F.lit("','k':"), k, F.lit("}")))
        .when(rest == 1, F.concat(F.lit('{status: "'), status, F.lit('", priority: "'), priority, F.lit('", k: '), k, F.lit("}")))
        .when(rest == 2, F.concat(F.lit('{"status":"'), status, F.lit('",\n// note\n"priority":"'), priority, F.lit('","k":'), k, F.lit(",}")))
        .when(rest == 3, F.concat(F.lit('{"status":"'), status, F.lit('" /* a */ ,"priority":"'), priority, F.lit('","k":'), k, F.lit(" ,}")))
        .otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"status":"'), status, F.lit('",\n"priority":"'), priority, F.lit('"\n"x":"",}')))
    )
    parsed = mj.parse_reply(raw)["json"]
    fields = F.from_json(parsed, "status string, priority string, k string")
    return orders(spark, d).select("o_orderkey", fields.alias("f")).select("o_orderkey", "f.*")


def chunk_prompts(spark, d):
    made = chunks(spark, d)
    stage = F.when(F.col("chunk_index") == 0, F.lit("induction")).otherwise(F.lit("extraction"))
    return made.select(F.col("chunk_id").alias("prompt_id"), stage.alias("stage"), F.col("text").alias("prompt"))


def shout(prompt: str) -> str:
    """A completion function with failures: texts without a full stop are refused."""
    if "." not in prompt:
        raise ValueError("no sentence")
    return f"{len(prompt)} characters"


@query("batch_complete", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id AS prompt_id, CASE WHEN contains(text, '.') THEN length(text) || ' characters' ELSE '' END AS content,
  'rules' AS model, CASE WHEN contains(text, '.') THEN 2 ELSE 0 END::BIGINT AS completion_tokens,
  CASE WHEN NOT contains(text, '.') THEN 'no sentence' END AS error FROM chunks
""")
def batch_complete(spark, d):
    made = model.batch_complete(chunk_prompts(spark, d), shout)
    return made.select("prompt_id", "content", "model", "completion_tokens", "error")


@query("complete_stored", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id AS prompt_id, CASE WHEN contains(text, '.') THEN length(text) || ' characters' ELSE '' END AS content,
  CASE WHEN NOT contains(text, '.') THEN 'no sentence' END AS error,
  CASE WHEN contains(text, '.') AND chunk_index = 0 THEN 0 ELSE 1 END::INTEGER AS run FROM chunks
""")
def complete_stored(spark, d):
    """Replies to first chunks are kept; the run over all chunks asks for the others and for what failed."""
    prompts, path = chunk_prompts(spark, d), shared_dir(spark, "stored-replies")
    model.complete_stored(prompts.filter(F.col("stage") == "induction"), shout, path, slices=2)
    made = model.complete_stored(prompts, shout, path, slices=4, at_once=4)
    return made.select("prompt_id", "content", "error", "run")


@query("model_usage", f"""
WITH {CHUNKS_SQL}
SELECT CASE WHEN chunk_index = 0 THEN 'induction' ELSE 'extraction' END AS stage, 'rules' AS model, count(*)::BIGINT AS calls,
  count(*) FILTER (NOT contains(text, '.'))::BIGINT AS errors,
  sum(CASE WHEN contains(text, '.') THEN 2 ELSE 0 END)::BIGINT AS completion_tokens FROM chunks GROUP BY ALL
""")
def model_usage(spark, d):
    replies = model.batch_complete(chunk_prompts(spark, d), shout, keep=["prompt_id", "stage"])
    return model.model_usage(replies).select("stage", "model", "calls", "errors", "completion_tokens")


@query("batch_prompts", f"""
WITH {CHUNKS_SQL}
SELECT doc_id, chunk_index // 10 AS prompt_index, count(*)::BIGINT AS chunks,
       md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS prompt_md5 FROM chunks GROUP BY ALL
""")
def batch_prompts(spark, d):
    made = model.batch_prompts(chunks(spark, d))
    return made.select("doc_id", "prompt_index", F.col("chunks").cast("bigint"), F.md5("prompt").alias("prompt_md5"))


@query("dedup_extraction", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id, sha256(text) AS text_hash, CASE WHEN contains(text, '.') THEN length(text) || ' characters' ELSE '' END AS content
FROM chunks
""")
def dedup_extraction(spark, d):
    return model.complete_distinct(chunks(spark, d), shout).select("chunk_id", "text_hash", "content")
