"""Prompt packs, recipes and policies: text artifacts as typed rows, with what is wrong with each instead of a first error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.nested import canonical

# Names that mean no schema, defaults of a pack, the separators of its canonical form and of a set's digest.
NO_SCHEMA = ("", "none", "null", "-")
MAX_TOKENS, TEMPERATURE = "512", "0"
UNIT, ROUTES = "\x1e", "\0ROUTES\0"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def _lines(x: Column) -> Column:
    """Text with plain line ends."""
    return F.regexp_replace(x, r"\r\n?", "\n")


def _settled(x: Column) -> Column:
    """Text without white space at line ends and without empty lines at its end: an edit of those alone changes no digest."""
    return F.regexp_replace(F.regexp_replace(_lines(x), r"(?mU)[^\S\n]+$", ""), r"\n+\z", "")


def packs(files: DataFrame, schemas: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with id, role, scenarios, max_tokens, temperature, schema_name, schema, system, user, and ``faults``.

    A pack is a front matter of ``key: value`` lines between lines of dashes, then the sections [system] and [user].
    ``schemas``: (schema_name, schema), a bounded registry of JSON texts."""
    raw = files.withColumn("_t", _lines(F.col(text)))
    fenced = F.startswith("_t", F.lit("---\n"))
    stop = F.locate("\n---\n", F.col("_t"), 5)
    raw = raw.withColumns({"_open": fenced & (stop == 0), "_head": F.when(fenced & (stop > 0), F.substring("_t", F.lit(5), stop - 5)).otherwise(""), "_body": F.when(fenced & (stop > 0), F.substring("_t", stop + 5, F.length("_t"))).otherwise(F.col("_t"))})
    entries = F.transform(F.filter(F.split("_head", "\n"), lambda line: line.contains(":")), lambda line: F.struct(_trimmed(F.split_part(line, F.lit(":"), F.lit(1))).alias("key"), _trimmed(F.substring(line, F.locate(":", line) + 1, F.length(line))).alias("value")))
    raw = raw.withColumn("_pairs", entries)
    # of a repeated key the last line counts
    first = lambda key, default: F.when(F.exists("_pairs", lambda e: e["key"] == key), F.try_element_at(F.reverse(F.transform(F.filter("_pairs", lambda e: e["key"] == key), lambda e: e["value"])), F.lit(1))).otherwise(F.lit(default))
    # the first header is [system], its section ends at the next [user]; a header's line ends at its own line end, so that a
    # section of white space alone is kept
    header = r"(?m:^(?=\[(?:system|user)\][^\S\n]*$))"
    sections = rf"(?s)\A(?>.*?{header})\[system\][^\S\n]*(\n.*?)(?m:^\[user\][^\S\n]*$)(.*)\z"
    inner = lambda i: F.regexp_replace(F.regexp_extract("_body", sections, i), r"\A\n+|\n+\z", "")
    named = raw.withColumns(
        {
            "id": first("id", ""),
            "role": first("role", ""),
            "scenarios": F.filter(F.transform(F.split(first("scenario", ""), ","), _trimmed), lambda s: s != ""),
            "max_tokens": F.regexp_extract(first("max_tokens", MAX_TOKENS), r"\A[+-]?\d+\z", 0).try_cast("int"),
            "temperature": first("temperature", TEMPERATURE).try_cast("double"),
            "schema_name": F.when(F.lower(first("schema", "none")).isin(*NO_SCHEMA), "").otherwise(first("schema", "none")),
            "_parts": F.col("_body").rlike(sections),
            "system": inner(1),
            "user": inner(2),
        }
    )
    known = F.broadcast(schemas.select(F.col("schema_name").alias("_n"), canonical(F.col("schema")).alias("_s")))
    both = named.join(known, F.col("schema_name") == F.col("_n"), "left")
    bad = lambda broken, fault: F.when(broken, F.lit(fault))
    faults = F.array_compact(
        F.array(
            bad(F.col("_open"), "the front matter is not closed"),
            bad(~F.col("_parts"), "no [system] section with a [user] section after it"),
            bad((F.col("id") == "") | (F.col("role") == ""), "no id or role"),
            bad((F.col("schema_name") != "") & F.col("_n").isNull(), "an unknown schema"),
            bad(F.col("max_tokens").isNull() | F.col("temperature").isNull(), "max_tokens or temperature is no number"),
        )
    )
    out = both.withColumns({"faults": faults, "schema": F.when(F.col("schema_name") == "", "{}").otherwise(F.col("_s"))})
    return out.select(*files.columns, "id", "role", "scenarios", "max_tokens", "temperature", "schema_name", "schema", "system", "user", "faults")


def pack_form() -> Column:
    """The canonical text of a pack: all that a model sees, and nothing else."""
    parts = [("id=", F.col("id")), ("role=", F.col("role")), ("max_tokens=", F.col("max_tokens").cast("string")), ("temperature=", F.col("temperature").cast("string")), ("schema=", F.col("schema"))]
    parts += [("system=\n", _settled(F.col("system"))), ("user=\n", _settled(F.col("user")))]
    return F.concat_ws(UNIT, *[F.concat(F.lit(name), value) for name, value in parts])


def pack_digests(held: DataFrame) -> DataFrame:
    """``held`` (packs) with the eight hex digits of each; a pack with faults raises."""
    wrong = F.raise_error(F.concat(F.lit("the pack "), F.col("id"), F.lit(" has faults: "), F.array_join("faults", "; "))).cast("string")
    return held.withColumn("digest", F.when(F.size("faults") > 0, wrong).otherwise(F.left(F.sha2(pack_form(), 256), F.lit(8))))


def set_digest(held: DataFrame, routes: Column, *group: str) -> DataFrame:
    """(group, digest, n): the eight hex digits of each group's packs in order of id, and of its routes (JSON, a column that is
    one for a group). A set is what a service loads, so it is small."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", pack_form().alias("form")))), lambda r: r["form"]), "\0")
    one = held.where(F.size("faults") == 0).withColumn("_routes", canonical(routes)).groupBy(*group).agg(whole.alias("_w"), F.min("_routes").alias("_r"), F.count("*").alias("n"))
    return one.select(*group, F.left(F.sha2(F.concat("_w", F.lit(ROUTES), "_r"), 256), F.lit(8)).alias("digest"), "n")


#: The fields of recipes and policies: path in the JSON text, and type.
RECIPE = {
    "recipe_id": "string", "amplify.variants": "int", "amplify.neg_frac": "double", "amplify.ok_rate_min": "double", "replay.frac": "double", "replay.source": "string", "replay.neg_boost": "double",
    "train.lora_r": "int", "train.lora_alpha": "int", "train.lr": "double", "train.epochs": "int", "train.batch_size": "int", "train.chunk_tokens": "int", "train.objective": "string",
    "corpus.quality_min": "double", "corpus.block_segments": "int", "corpus.segment_seconds": "int", "window.boundary_local_time": "string",
}
POLICY = {
    "policy_id": "string", "gate.new_day_recall_min": "double", "gate.traps_pass_min": "double", "gate.heldout.alpha": "double", "gate.heldout.backstop": "double", "gate.heldout.probes": "int",
    "gate.min_probes": "int", "gate.decay_retention_min": "double", "gate.consecutive_fail_freeze": "int", "publish.snapshot_retention": "int",
}


def artifacts(files: DataFrame, fields: dict[str, str], text: str = "text") -> DataFrame:
    """``files`` with a typed column per field (dots as underscores) and ``faults``: a text that is no JSON object, a field that
    is missing, or one that is not of its type. Further fields are free."""
    doc = F.try_parse_json(F.col(text))
    raw = files.withColumn("_v", doc)
    at = {path: F.try_variant_get("_v", f"$.{path}", kind) for path, kind in fields.items()}
    there = {path: F.try_variant_get("_v", f"$.{path}", "variant") for path in fields}
    no_object = ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    missing = [F.when(there[p].isNull() | F.is_variant_null(there[p]), F.lit(f"{p}: missing")).when(at[p].isNull(), F.lit(f"{p}: no {k}")) for p, k in fields.items()]
    faults = F.when(no_object, F.array(F.lit("no JSON object"))).otherwise(F.array_compact(F.array(*missing)))
    return raw.withColumns({p.replace(".", "_"): c for p, c in at.items()} | {"faults": faults}).drop("_v")
