"""From loosely structured JSON documents to catalog rows and text chunks.

Documents are parsed as VARIANT, so that a field may be a string in one register and a list in the
next. Objects keep their fields in key order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import first_filled, join_filled, strip_scheme
from meridian.schemas import INDEXER_VERSION

#: Field names of the documents.
REGISTER_ITEMS = "bblocks"
EDGE_KINDS = ("dependsOn", "isProfileOf")
USAGE_LIMIT = 2000


def parsed(body: Column | str) -> Column:
    return F.try_parse_json(body)


def text_at(v: Column, path: str) -> Column:
    """A field if it is a string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def list_at(v: Column, path: str) -> Column:
    """A field as a list of variants: a list is itself, another value is a list of one, none is empty."""
    value = F.try_variant_get(v, path, "variant")
    none = F.array().cast("array<variant>")
    return F.when(value.isNull() | (F.schema_of_variant(value) == "VOID"), none).when(is_list(value), F.try_variant_get(v, path, "array<variant>")).otherwise(F.array(value))


def object_at(v: Column, path: str) -> Column:
    """A field as a map of variants, empty unless it is an object."""
    value = F.try_variant_get(v, path, "variant")
    empty = F.create_map().cast("map<string,variant>")
    return F.when(is_object(value), F.try_variant_get(v, path, "map<string,variant>")).otherwise(empty)


def texts_in(values: Column) -> Column:
    """The strings of a list of variants."""
    return F.transform(F.filter(values, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))


def require_object(df: DataFrame, column: str = "v") -> DataFrame:
    """Fails the job on a document that is not a JSON object."""
    return df.withColumn(column, F.when(is_object(F.col(column)), F.col(column)).otherwise(F.raise_error(F.lit("document is not a JSON object")).cast("variant")))


def organizations(documents: DataFrame) -> DataFrame:
    """Rows of an organizations document: a map from id to its facts. The name defaults to the id."""
    entries = require_object(documents.select(parsed("body").alias("v"))).select(F.explode(F.expr("cast(v as map<string,variant>)")).alias("id", "o"))
    maintainers = F.transform(list_at(F.col("o"), "$.maintainers"), lambda m: F.struct(F.try_variant_get(m, "$.github", "string").alias("github"), F.try_variant_get(m, "$.email", "string").alias("email")))
    return entries.select("id", F.coalesce(text_at(F.col("o"), "$.name"), "id").alias("name"), text_at(F.col("o"), "$.description").alias("description"), text_at(F.col("o"), "$.url").alias("url"), maintainers.alias("maintainers"))


def registers(documents: DataFrame) -> DataFrame:
    """Rows of an index document: ``@org/name`` to URL. Other keys are left out; only the first slash splits."""
    entries = require_object(documents.select(parsed("body").alias("v"))).select(F.explode(F.expr("cast(v as map<string,variant>)")).alias("alias", "u"))
    named = entries.filter(F.startswith("alias", F.lit("@")) & F.contains("alias", F.lit("/")))
    parts = F.split(F.substring("alias", 2, 1 << 30), "/", 2)
    return named.select(F.concat_ws("/", parts[0], parts[1]).alias("id"), parts[0].alias("org_id"), parts[1].alias("name"), F.col("u").cast("string").alias("register_url"))


def register_facts(fetched: DataFrame) -> DataFrame:
    """``fetched(id, org_id, name, register_url, body)`` with what the register says about itself.

    An empty string counts as missing for the name and the description.
    """
    v = parsed("body")
    return fetched.select("id", "org_id", "register_url", v.alias("v"), "name").select(
        "id", "org_id", first_filled(text_at(F.col("v"), "$.name"), F.col("name")).alias("name"), "register_url", text_at(F.col("v"), "$.viewerURL").alias("viewer_url"),
        first_filled(text_at(F.col("v"), "$.abstract"), text_at(F.col("v"), "$.description")).alias("description"), text_at(F.col("v"), "$.modified").alias("modified"),
    )


def raw_items(fetched: DataFrame) -> DataFrame:
    """``register_id, org_id, register_url, position, item_id, raw``: every item that has an identifier."""
    v = fetched.select(F.col("id").alias("register_id"), "org_id", "register_url", parsed("body").alias("v"))
    listed = v.select("register_id", "org_id", "register_url", F.posexplode(list_at(F.col("v"), f"$.{REGISTER_ITEMS}")).alias("position", "raw"))
    return listed.withColumn("item_id", text_at(F.col("raw"), "$.itemIdentifier")).filter(F.col("item_id").isNotNull() & (F.col("item_id") != ""))


def claims(raw: DataFrame, order: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Every raw item with the register that owns its identifier, ``owner``, and whether it is ``accepted``.

    ``order(register_id, crawl_seq)``. An owner from before, ``owners(item_id, register_id)``, keeps its
    identifier unless it is crawled again itself; else the first register does. An identifier repeated
    in its own register counts once, at its first place.
    """
    rows = raw.join(order, "register_id")
    if owners is not None:
        kept = owners.join(order.select("register_id"), "register_id", "left_anti").select("item_id", F.col("register_id").alias("held"))
        rows = rows.join(kept, "item_id", "left")
    else:
        rows = rows.withColumn("held", F.lit(None).cast("string"))
    first = F.min(F.struct("crawl_seq", "register_id")).over(Window.partitionBy("item_id"))
    at = F.row_number().over(Window.partitionBy("item_id", "register_id").orderBy("position"))
    owned = rows.withColumn("owner", F.coalesce("held", first["register_id"])).withColumn("__n", at)
    return owned.filter("__n = 1").withColumn("accepted", F.col("owner") == F.col("register_id")).drop("__n", "held")


def conflicts(claimed: DataFrame) -> DataFrame:
    """Rejected claims, each once."""
    lost = claimed.filter("not accepted")
    return lost.select(F.col("item_id").alias("conflicting_id"), F.col("owner").alias("existing_register_id"), F.col("register_id").alias("attempted_register_id")).distinct()


def items(accepted: DataFrame) -> DataFrame:
    """Catalog rows of raw items. A name that is missing is the id; an empty one stays."""
    raw = F.col("raw")
    shapes = object_at(raw, "$.shaclShapes")
    value = F.try_variant_get(raw, "$.shaclShapes", "variant")
    flat = F.flatten(F.transform(F.map_values(shapes), lambda x: texts_in(F.when(is_list(x), x.cast("array<variant>")).otherwise(F.array().cast("array<variant>")))))
    urls = F.when(is_object(value), flat).when(is_list(value), texts_in(list_at(raw, "$.shaclShapes"))).otherwise(F.array().cast("array<string>"))
    schema = F.transform_values(object_at(raw, "$.schema"), lambda _, x: x.cast("string"))
    context = F.nullif(text_at(raw, "$.ldContext"), F.lit(""))
    sources = F.transform(list_at(raw, "$.sources"), lambda s: F.struct(F.try_variant_get(s, "$.title", "string").alias("title"), F.try_variant_get(s, "$.link", "string").alias("link")))
    plain = {"abstract": "abstract", "status": "status", "item_class": "itemClass", "version": "version", "date_time_addition": "dateTimeAddition", "date_of_last_change": "dateOfLastChange"}
    rows = accepted.select(
        F.col("item_id").alias("id"), "register_id", F.coalesce(text_at(raw, "$.name"), "item_id").alias("name"),
        *[text_at(raw, f"$.{field}").alias(name) for name, field in plain.items()], texts_in(list_at(raw, "$.tags")).alias("tags"),
        schema.alias("schema_urls"), context.alias("ld_context_url"), urls.alias("shacl_shapes_urls"), sources.alias("sources"),
    )
    return rows.withColumns({"has_schema": F.size("schema_urls") > 0, "has_ld_context": F.col("ld_context_url").isNotNull(), "has_shacl_shapes": F.size("shacl_shapes_urls") > 0})


def edges(accepted: DataFrame) -> DataFrame:
    """``source_id, target_id, kind``: links as a list or one string, with or without the scheme, each once."""
    parts = []
    for kind in EDGE_KINDS:
        targets = F.filter(texts_in(list_at(F.col("raw"), f"$.{kind}")), lambda t: t != "")
        parts.append(accepted.select(F.col("item_id").alias("source_id"), F.explode(targets).alias("t"), F.lit(kind).alias("kind")))
    return reduce(DataFrame.unionByName, parts).select("source_id", strip_scheme(F.col("t")).alias("target_id"), "kind").distinct()


def needs_reindex(fetched_modified: Column, stored_modified: Column, stored_version: Column, version: int = INDEXER_VERSION) -> Column:
    """The marker differs, or the row was indexed under another version; null equals null."""
    return ~fetched_modified.eqNullSafe(stored_modified) | ~stored_version.eqNullSafe(F.lit(version))


def context_fields(v: Column) -> Column:
    """``(field, uri)`` of a JSON-LD context: an object or a list of objects, values as strings or as
    objects with ``@id``; names that start with ``@`` are directives."""

    def uri(x: Column) -> Column:
        return F.when(is_text(x), x.cast("string")).when(is_object(x), F.try_variant_get(x, "$['@id']", "string"))

    objects = F.filter(list_at(v, "$['@context']"), is_object)
    entries = F.flatten(F.transform(objects, lambda o: F.map_entries(o.cast("map<string,variant>"))))
    pairs = F.transform(entries, lambda e: F.struct(e["key"].alias("field"), uri(e["value"]).alias("uri")))
    return F.filter(pairs, lambda p: ~F.startswith(p["field"], F.lit("@")) & p["uri"].isNotNull() & (p["uri"] != ""))


def property_paths(v: Column) -> Column:
    """Dotted paths of resolved properties, each once, in order."""
    paths = F.transform(list_at(v, "$.properties"), lambda p: F.try_variant_get(p, "$.path", "array<string>"))
    return F.array_distinct(F.transform(F.filter(paths, lambda p: p.isNotNull() & (F.size(p) > 0)), lambda p: F.array_join(p, ".")))


def core_text(raw: Column) -> Column:
    tags = texts_in(list_at(raw, "$.tags"))
    return join_filled("\n", text_at(raw, "$.name"), text_at(raw, "$.abstract"), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))


def _filled_of(values: Column, path: str) -> Column:
    return F.filter(F.transform(values, lambda x: F.try_variant_get(x, path, "string")), lambda t: t.isNotNull() & (t != ""))


def usage_text(raw: Column, full: Column, limit: int = USAGE_LIMIT) -> Column:
    """Sources, transforms, then of each example its title, content and first JSON snippet, cut to ``limit``."""
    titles = _filled_of(list_at(raw, "$.sources"), "$.title")
    transforms = _filled_of(list_at(raw, "$.transforms"), "$.description")

    def example(e: Column) -> Column:
        json = F.filter(list_at(e, "$.snippets"), lambda s: (F.try_variant_get(s, "$.language", "string") == "json") & (F.coalesce(F.try_variant_get(s, "$.code", "string"), F.lit("")) != ""))
        code = F.try_variant_get(F.try_element_at(json, F.lit(1)), "$.code", "string")
        return F.array(F.try_variant_get(e, "$.title", "string"), F.try_variant_get(e, "$.content", "string"), code)

    lines = F.flatten(F.transform(F.filter(list_at(full, "$.examples"), is_object), example))
    shown = F.filter(lines, lambda t: t.isNotNull() & (t != ""))
    head = F.array(F.when(F.size(titles) > 0, F.concat(F.lit("Sources: "), F.array_join(titles, ", "))), F.when(F.size(transforms) > 0, F.concat(F.lit("Transforms: "), F.array_join(transforms, "; "))))
    return F.substring(F.array_join(F.array_compact(F.concat(head, shown)), "\n"), 1, limit)


def chunks(fetched: DataFrame, accepted: DataFrame, fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text chunks of registers and items, and ``item_id, register_id`` of the items that failed.

    ``fetches(url, body, error)`` holds the linked documents. An item whose full document could not be
    fetched gives no chunk and is reported; a context or property document that could not be fetched
    only leaves its chunk out. Properties stand in where the context says nothing.
    """
    raw = F.col("raw")
    links = {"full": "$.documentation['json-full'].url", "context": "$.ldContext", "resolved": "$.resolvedSchemaProperties"}
    rows = accepted.select("register_id", "org_id", "register_url", "item_id", "raw", *[F.nullif(text_at(raw, p), F.lit("")).alias(f"{n}_url") for n, p in links.items()])
    for name in links:
        got = fetches.select(F.col("url").alias(f"{name}_url"), F.col("body").alias(f"{name}_body"), F.col("error").alias(f"{name}_error"))
        rows = rows.join(got, f"{name}_url", "left").withColumn(name, parsed(f"{name}_body"))
    bad = F.col("full_url").isNotNull() & (F.col("full_error").isNotNull() | F.col("full_body").isNull())
    failed = rows.filter(bad).select("item_id", "register_id")
    good = rows.filter(~bad)
    fields = F.array_join(F.transform(context_fields(F.col("context")), lambda p: F.concat_ws(": ", p["field"], p["uri"])), "\n")
    schema = first_filled(F.when(is_object(F.col("context")), fields), F.when(is_object(F.col("resolved")), F.array_join(property_paths(F.col("resolved")), "\n")))
    full = F.when(is_object(F.col("full")), F.col("full"))
    by_type = {"item_core": core_text(raw), "item_description": text_at(full, "$.description"), "item_schema": schema, "item_usage": usage_text(raw, full)}
    texts = F.array(*[F.struct(F.lit(kind).alias("chunk_type"), text.alias("text")) for kind, text in by_type.items()])
    own = good.select("org_id", "register_url", "item_id", text_at(raw, "$.itemClass").alias("item_class"), text_at(raw, "$.status").alias("status"), F.explode(texts).alias("t"))
    own = own.select(F.concat_ws(":", "t.chunk_type", "item_id").alias("chunk_key"), "t.text", "t.chunk_type", F.col("org_id").alias("org"), "register_url", "item_id", "item_class", "status")
    v = F.col("v")
    summaries = fetched.select("org_id", "register_url", parsed("body").alias("v")).select(
        F.concat(F.lit("register_summary:"), "register_url").alias("chunk_key"), join_filled("\n", text_at(v, "$.name"), text_at(v, "$.abstract"), text_at(v, "$.description")).alias("text"),
        F.lit("register_summary").alias("chunk_type"), F.col("org_id").alias("org"), "register_url", *[F.lit(None).cast("string").alias(c) for c in ("item_id", "item_class", "status")],
    )
    return own.unionByName(summaries).filter(F.coalesce("text", F.lit("")) != ""), failed
