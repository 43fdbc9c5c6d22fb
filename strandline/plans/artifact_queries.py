"""Queries over packs, recipes and replies in chunks, made from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import packs
from strandline.sources.tables import table
from strandline.streaming import replies


def _docs(spark, d):
    """Documents with an identifier as text, and a line of letters of their own."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text", "lang")
    return docs.withColumns({"n": F.col("doc_id").cast("string"), "plain": F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")})


def _packs(spark, d):
    """A pack per document; some lack their end of the front matter, a section, an identifier, a schema or a number."""
    k = F.col("doc_id") % 10
    head = F.concat(F.lit("---\r\nid: p"), F.when(k != 3, F.col("n")).otherwise(""), F.lit("\nrole: clip\nscenario: idle, ,text\nschema: "), F.when(k == 4, "strange").when(k == 5, "None").otherwise("frame"), F.lit("\nmax_tokens: "), F.when(k == 6, "many").otherwise("64"), F.when(k == 1, "\n").otherwise("\n---\n"))
    head = F.when(k == 3, F.replace(head, F.lit("id: p"), F.lit("id:"))).otherwise(head)
    body = F.concat(F.lit("\n[system]\n"), F.col("plain"), F.lit("  \n\n"), F.when(k == 2, "[usr]").otherwise("[user]"), F.lit("\nSay it.\n"))
    files = _docs(spark, d).select("doc_id", "lang", F.concat(head, body).alias("text"), F.length("plain").alias("chars"))
    return packs.packs(files, spark.createDataFrame([("frame", '{"b": 1, "a": [2]}')], "schema_name string, schema string"))


def prompt_packs(spark, d):
    got = _packs(spark, d)
    return got.select("doc_id", "id", "schema", "max_tokens", F.size("scenarios").alias("n_scenarios"), F.length("system").alias("chars"), F.array_join("faults", "; ").alias("faults"))


def pack_sets(spark, d):
    """The digest of each hundred packs."""
    got = _packs(spark, d).withColumn("set", F.floor(F.col("doc_id") / 100)).withColumn("system", F.lit("s"))
    return packs.set_digest(got, F.lit('{"z": "p1", "a": {"k": []}}'), "set")


def policies_parsed(spark, d):
    k = F.col("doc_id") % 5
    gate = F.concat(F.lit('{"new_day_recall_min": 0.'), F.col("n"), F.lit(', "traps_pass_min": '), F.when(k == 1, '"high"').otherwise("0.25"), F.lit(', "heldout": {"alpha": 0.01, "backstop": 0.5'), F.when(k == 2, "").otherwise(', "probes": 222'), F.lit('}, "min_probes": 148, "decay_retention_min": 0.5, "consecutive_fail_freeze": 2, "note": "x"}'))
    text = F.when(k == 3, "[1]").otherwise(F.concat(F.lit('{"policy_id": "p'), F.col("n"), F.lit('", "publish": {"snapshot_retention": 14}, "gate": '), gate, F.lit("}")))
    got = packs.artifacts(_docs(spark, d).select("doc_id", text.alias("text")), packs.POLICY)
    return got.select("doc_id", "policy_id", "gate_traps_pass_min", "gate_heldout_probes", "publish_snapshot_retention", F.array_join("faults", "; ").alias("faults"))


def _chunks(spark, d):
    """Each document's text as a reply with a frame, in chunks of 700 bytes, which cut characters."""
    k = F.col("doc_id") % 4
    frame = F.when(k == 0, '{"ok": true}').when(k == 1, "[]").when(k == 2, '{"ok"').otherwise("")
    whole = F.encode(F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\x1e"), F.lit(" ")), F.when(k == 3, "").otherwise("\x1e"), frame), "utf-8")
    rows = table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("reply"), F.monotonically_increasing_id().alias("row"), whole.alias("b"))
    one = rows.groupBy("reply").agg(F.min_by("b", "row").alias("b"))
    return one.select("reply", "b", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("b") / 700).cast("int"))).alias("n")).select("reply", F.col("n").cast("long").alias("n"), F.substring("b", F.col("n") * 700 + 1, F.lit(700)).alias("data"))


def replies_split(spark, d):
    got = replies.split_replies(_chunks(spark, d), "reply", "n", "data")
    return got.select("reply", F.sha2("answer", 256).alias("answer"), "frame", "error")


QUERIES = {
    "prompt_packs": (prompt_packs, r"""with x as (select doc_id, doc_id % 10 as k, length(trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), chr(10))) as n from documents where doc_id is not null)
        select doc_id, case when k in (1, 3) then '' else 'p' || doc_id end as id, case when k = 4 then null when k in (1, 5) then '{}' else '{"a":[2],"b":1}' end as schema, case when k = 6 then null when k = 1 then 512 else 64 end as max_tokens,
        case when k = 1 then 0 else 2 end as n_scenarios, case when k = 2 then 0 else (n + 2)::integer end as chars,
        case k when 1 then 'the front matter is not closed; no id or role' when 2 then 'no [system] section with a [user] section after it' when 3 then 'no id or role' when 4 then 'an unknown schema' when 6 then 'max_tokens or temperature is no number' else '' end as faults from x"""),
    "pack_sets": (pack_sets, r"""with x as (select doc_id, doc_id // 100 as set, 'p' || doc_id as id, case when doc_id % 10 = 5 then '{}' else '{"a":[2],"b":1}' end as schema from documents where doc_id is not null and doc_id % 10 not in (1, 2, 3, 4, 6)),
        f as (select set, id, 'id=' || id || chr(30) || 'role=clip' || chr(30) || 'max_tokens=64' || chr(30) || 'temperature=0.0' || chr(30) || 'schema=' || schema || chr(30) || 'system=' || chr(10) || 's' || chr(30) || 'user=' || chr(10) || 'Say it.' as form from x)
        select set, left(sha256(string_agg(form, chr(0) order by id) || chr(0) || 'ROUTES' || chr(0) || '{"a":{"k":[]},"z":"p1"}'), 8) as digest, count(*) as n from f group by 1"""),
    "policies_parsed": (policies_parsed, """select doc_id, case when doc_id % 5 <> 3 then 'p' || doc_id end as policy_id, case when doc_id % 5 in (0, 2, 4) then 0.25::double end as gate_traps_pass_min, case when doc_id % 5 in (0, 1, 4) then 222 end as gate_heldout_probes,
        case when doc_id % 5 <> 3 then 14 end as publish_snapshot_retention, case doc_id % 5 when 1 then 'gate.traps_pass_min: no double' when 2 then 'gate.heldout.probes: missing' when 3 then 'no JSON object' else '' end as faults from documents where doc_id is not null"""),
    "replies_split": (replies_split, """select cast(doc_id as varchar) as reply, sha256(replace(coalesce(text, ''), chr(30), ' ')) as answer, case when doc_id % 4 = 0 then '{"ok":true}' end as frame,
        case doc_id % 4 when 1 then 'the end frame is no object' when 2 then 'malformed end frame' when 3 then 'missing end frame' end as error from documents where doc_id is not null"""),
}
