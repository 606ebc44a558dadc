"""Reference documents: worlds, revisions, entries, chunks; scope, overlays, search, order, integrity, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, normalize_baseline, tokens_baseline
from . import likeness


def segment_untitled(texts: DataFrame, limit: int = 8, preview: int = 180) -> DataFrame:
    """Paragraphs if there are several, else sentences: (id, index, length, preview). texts: (id, text)."""
    tidy = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(" \n\t\r"))), lambda x: x != "")
    paragraphs, sentences = tidy(F.split("text", r"\n{2,}")), tidy(F.split("text", r"(?<=[.!?。！？])\s+"))
    parts = F.slice(F.when(F.size(paragraphs) > 1, paragraphs).otherwise(sentences), 1, limit)
    rows = texts.select("id", F.posexplode(parts).alias("index", "part"))
    return rows.select("id", "index", F.length("part").alias("length"), F.left("part", F.lit(preview)).alias("preview"))


def titled_entries(files: DataFrame) -> DataFrame:
    """(path, index, title, content) of a text split at first and second level headings; what precedes the first is a preamble."""
    parts = F.split("text", r"(?m)(?=^#{1,2}[ \t]+\S)")
    rows = files.select("path", F.posexplode(F.filter(parts, lambda p: F.trim(p, F.lit(" \n\t\r")) != "")).alias("index", "part"))
    title = F.trim(F.regexp_extract("part", r"\A#{1,2}[ \t]+([^\n]*)", 1))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    content = F.trim(F.regexp_replace("part", r"\A#{1,2}[ \t]+[^\n]*\n?", ""), F.lit(" \n\t\r"))
    return rows.select("path", "index", F.when(title != "", title).otherwise(stem).alias("title"), content.alias("content"))


def route_format(name: Column, text: Column) -> Column:
    """Json or text, by extension, else by the first character and whether it parses."""
    low = F.lower(name)
    return F.when(low.endswith(".json"), "json").when(low.rlike(r"\.(txt|md|markdown)$"), "text").when(F.try_parse_json(text).isNotNull() & F.ltrim(text).rlike(r"^[\[{]"), "json").otherwise("text")


def worldbook_entries(files: DataFrame) -> DataFrame:
    """Entries of world-info JSON (a root array, an entries array or an entries object); fields that aren't known are kept in raw_extra.

    files: (path, text). Title: the title, else the first Markdown heading, else the comment. Entries that aren't objects are left out.
    """
    v = F.try_parse_json("text")
    body = F.coalesce(F.try_variant_get(v, "$.entries", "variant"), v)
    entry = F.coalesce(F.try_variant_get(body, "$", "array<variant>"), F.map_values(F.try_variant_get(body, "$", "map<string,variant>")))
    rows = files.select("path", F.posexplode(entry).alias("index", "e")).withColumn("m", F.try_variant_get("e", "$", "map<string,variant>")).where("m is not null")
    text = lambda key: F.try_variant_get("e", f"$.{key}", "string")
    true = lambda key: F.coalesce(F.try_variant_get("e", f"$.{key}", "boolean"), F.lit(False))
    heading = F.trim(F.regexp_extract(F.coalesce(text("content"), F.lit("")), r"(?m)^#{1,6}[ \t]+(.+)$", 1))
    known = ("uid", "title", "comment", "content", "key", "keysecondary", "constant", "disable", "disabled", "enabled", "secret", "visibility", "order")
    keys = lambda key: F.coalesce(F.try_variant_get("e", f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    return rows.select(
        "path", "index", F.coalesce(F.when(F.trim(text("title")) != "", text("title")), F.when(heading != "", heading), text("comment"), F.lit("")).alias("title"),
        F.coalesce(text("content"), F.lit("")).alias("content"), keys("key").alias("keys"), keys("keysecondary").alias("secondary_keys"), true("constant").alias("constant"),
        (true("disable") | true("disabled") | ~F.coalesce(F.try_variant_get("e", "$.enabled", "boolean"), F.lit(True))).alias("disabled"),
        (true("secret") | F.coalesce(text("visibility") == "secret", F.lit(False))).alias("secret"), F.try_variant_get("e", "$.order", "double").alias("ord"),
        F.map_filter("m", lambda k, _: ~k.isin(*known)).alias("raw_extra"),
    )


def active_scope(worlds: DataFrame, revisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of each world's active baseline (place 0) and of its active extensions that build on it, in order."""
    base = worlds.select("world_id", F.col("baseline_id").alias("revision_id"), F.col("baseline_id"), F.lit(0).alias("place"))
    ext = worlds.select("world_id", "baseline_id", F.posexplode("extension_ids").alias("k", "revision_id")).select("world_id", "revision_id", "baseline_id", (F.col("k") + 1).alias("place"))
    r = revisions.select("revision_id", "kind", "base_id")
    fits = (F.col("place") == 0) & (F.col("kind") == "baseline") | (F.col("place") > 0) & (F.col("kind") == "extension") & (F.col("base_id") == F.col("baseline_id"))
    scope = base.unionByName(ext).join(r, "revision_id").where(fits).select("world_id", "revision_id", "place")
    return entries.where("not disabled").join(scope, ["world_id", "revision_id"])


def bind(chats: DataFrame, worlds: DataFrame) -> DataFrame:
    """Each chat's own world where it still exists, else the default one."""
    w = worlds.select(F.col("world_id").alias("w"))
    default = worlds.agg(F.min("world_id").alias("default"))
    return chats.join(w, chats["world_id"] == w["w"], "left").crossJoin(default).select("conv_id", F.coalesce("w", "default").alias("world_id"), F.col("w").isNotNull().alias("own"))


def apply_overlays(entries: DataFrame, overlays: DataFrame, fields: list[str]) -> DataFrame:
    """Entries patched field by field. overlays: (entry_id, <field>, set_<field>): a field that is set replaces, null included."""
    o = overlays.select("entry_id", *[F.col(f).alias(f"o_{f}") for f in fields], *[F.col(f"set_{f}") for f in fields])
    new = {f: F.when(F.coalesce(F.col(f"set_{f}"), F.lit(False)), F.col(f"o_{f}")).otherwise(F.col(f)) for f in fields}
    return entries.join(o, "entry_id", "left").withColumns(new).drop(*[f"o_{f}" for f in fields], *[f"set_{f}" for f in fields])


def ignored_overlays(entries: DataFrame, overlays: DataFrame) -> DataFrame:
    return overlays.join(entries.select("entry_id"), "entry_id", "left_anti")


def integrity(worlds: DataFrame, sources: DataFrame, revisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Violations (rule, id) of the references between the tables."""
    lost = lambda rows, id_, key, other: rows.where(F.col(key).isNotNull()).join(other.select(F.col(other.columns[0]).alias(key)), key, "left_anti").select(F.lit(f"{id_}: unknown {key}").alias("rule"), F.col(id_).alias("id"))
    base = revisions.where("kind = 'baseline'").select("revision_id")
    out = [
        lost(sources, "source_id", "world_id", worlds.select("world_id")), lost(revisions, "revision_id", "source_id", sources.select("source_id")), lost(entries, "entry_id", "revision_id", revisions.select("revision_id")),
        revisions.where("kind = 'extension'").join(base.select(F.col("revision_id").alias("base_id")), "base_id", "left_anti").select(F.lit("extension without a baseline").alias("rule"), F.col("revision_id").alias("id")),
        revisions.where("kind = 'baseline' and base_id is not null").select(F.lit("baseline with a base").alias("rule"), F.col("revision_id").alias("id")),
        entries.where("trim(coalesce(content, '')) = ''").select(F.lit("empty content").alias("rule"), F.col("entry_id").alias("id")),
    ]
    return reduce(DataFrame.unionByName, [x.withColumn("id", F.col("id").cast("string")) for x in out])


def split_chunks(text: Column, most: int = 420, least: int = 18) -> Column:
    """Lines and sentences packed in order into pieces of at most so many characters; a shorter last piece joins the one before.

    A sentence longer than a piece is cut at every ``most`` characters.
    """
    lines = F.flatten(F.transform(F.split(text, r"\n+"), lambda x: F.split(F.trim(x), r"(?<=[.!?;。！？；])\s*")))
    long = F.flatten(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.regexp_extract_all(F.trim(x), F.lit(f"(?s).{{1,{most}}}"), F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    step = lambda s, x: F.when(s["now"] == "", F.struct(s["done"].alias("done"), x.alias("now"))).when(F.length(s["now"]) + 1 + F.length(x) <= most, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(" "), x).alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now")))
    last = lambda s: F.when(s["now"] == "", s["done"]).when((F.length(s["now"]) < least) & (F.size(s["done"]) > 0), F.concat(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), F.array(F.concat(F.element_at(s["done"], -1), F.lit(" "), s["now"])))).otherwise(F.concat(s["done"], F.array(s["now"])))
    return F.aggregate(long, start, step, last)


#: What a condition or an exception begins with.
CONDITION_LEADERS = (
    "如果", "若", "假如", "倘若", "除非", "除了", "当", "一旦", "否则", "不然",
    "但是", "但", "不过", "然而", "可是", "例外", "特殊", "只有", "仅在",
    "if", "unless", "except", "otherwise", "however", "but",
)


def glue_conditions(pieces: Column, leaders: tuple[str, ...] = CONDITION_LEADERS, most: int = 630) -> Column:
    """A piece that begins with one of the leaders joins the one before, up to a size."""
    begins = lambda x: F.lower(F.trim(x)).rlike("^(?:" + "|".join(leaders) + ")")
    start = F.array().cast("array<string>")
    step = lambda s, x: F.when((F.size(s) > 0) & begins(x) & (F.length(F.element_at(s, -1)) + 1 + F.length(x) <= most), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), F.lit(" "), x)))).otherwise(F.concat(s, F.array(x)))
    return F.aggregate(pieces, start, step)


def build_chunks(entries: DataFrame, most: int = 420) -> DataFrame:
    """(entry_id, chunk, title, text, retrieval_text, hash) of entries (entry_id, title, content)."""
    rows = entries.select(*[c for c in entries.columns if c != "content"], F.posexplode(glue_conditions(split_chunks(F.col("content"), most), most=most * 3 // 2)).alias("chunk", "text"))
    full = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("] "), "text")
    return rows.withColumn("retrieval_text", full).withColumn("hash", digest(F.concat_ws("\x1f", "entry_id", "chunk", "retrieval_text")))


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int = 12, least: float = 0.05) -> DataFrame:
    """Chunks of the query's world by similarity of body and retrieval text; candidates share a token with the query.

    Pairs are compared in blocks (``likeness``) and never written. (query_id, entry_id, chunk, constant, ord, score, rank)
    """
    rows = likeness.candidates(queries, chunks, k, least)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("constant").desc(), F.col("ord").asc_nulls_last(), "entry_id", "chunk")
    return rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def collapse_to_entry(chunk_scores: DataFrame) -> DataFrame:
    """A parent's score: the best chunk's, a quarter of the second's and a tenth of the third's. (query_id, entry_id, score)."""
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3)
    at = lambda i: F.coalesce(F.get(F.col("s"), F.lit(i)), F.lit(0.0))
    return chunk_scores.groupBy("query_id", "entry_id").agg(best.alias("s"), F.count(F.lit(1)).alias("chunks")).select("query_id", "entry_id", (at(0) + 0.25 * at(1) + 0.10 * at(2)).alias("score"), "chunks")


def entry_manifest(chunks: DataFrame) -> DataFrame:
    """Per entry its chunks, their hashes in order and a signature of them."""
    rows = F.array_sort(F.collect_list(F.struct("chunk", "hash")))
    m = chunks.groupBy("entry_id").agg(F.count(F.lit(1)).alias("chunks"), F.transform(rows, lambda x: x["hash"]).alias("hashes"))
    return m.withColumn("signature", digest(F.array_join(F.col("hashes").cast("array<string>"), ",")))


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """An order-free hash of all rows and their count, without gathering them."""
    return chunks.agg(F.bit_xor("hash").alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed, changed or unchanged, by entry, with the hashes to insert and to delete."""
    o = old.select("entry_id", F.col("signature").alias("so"), F.col("hashes").alias("ho"))
    n = new.select("entry_id", F.col("signature").alias("sn"), F.col("hashes").alias("hn"))
    none = F.array().cast("array<bigint>")
    change = F.when(F.col("so").isNull(), "added").when(F.col("sn").isNull(), "removed").when(F.col("so") == F.col("sn"), "unchanged").otherwise("changed")
    both = o.join(n, "entry_id", "full_outer").withColumn("change", change)
    return both.select("entry_id", "change", F.array_except(F.coalesce("hn", none), F.coalesce("ho", none)).alias("insert"), F.array_except(F.coalesce("ho", none), F.coalesce("hn", none)).alias("delete"))


def natural_key(value: Column) -> Column:
    """A sort key by which 2 comes before 10."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def index_summary(chunks: DataFrame) -> DataFrame:
    """Entries, chunks and constant chunks by world."""
    return chunks.groupBy("world_id").agg(F.count_distinct("entry_id").alias("entries"), F.count(F.lit(1)).alias("chunks"), F.count_if("constant").alias("constant_chunks"))


def normalize_entries(rows: DataFrame) -> DataFrame:
    """Typed, trimmed entries: strings without blanks around, distinct keys, numbers or null, unknown booleans false."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    fixed = {"title": text("title"), "content": text("content")}
    fixed |= {c: keys(c) for c in ("keys", "secondary_keys", "known_by") if c in rows.columns}
    fixed |= {c: F.coalesce(F.col(c), F.lit(False)) for c in ("constant", "disabled", "secret") if c in rows.columns}
    if "ord" in rows.columns:
        fixed["ord"] = F.col("ord").try_cast("double")
    return rows.withColumns(fixed)


def _text(c: str, default: str = "") -> Column:
    t = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(t == "", default).otherwise(t) if default else t


def _optional(c: str) -> Column:
    return F.when(_text(c) != "", _text(c))


def _stamp(c: str, now: int) -> Column:
    return F.coalesce(F.floor(F.col(c).try_cast("double")).try_cast("bigint"), F.lit(now).cast("long"))


def normalize_worlds(rows: DataFrame, now: int) -> DataFrame:
    """Worlds: trimmed texts, a name in any case, distinct revisions in order, stamps or now."""
    ids = F.coalesce("active_extension_revision_ids", F.array().cast("array<string>"))
    ids = F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    return rows.select(
        _text("world_id").alias("world_id"), _text("name", "Untitled World").alias("name"), _optional("active_baseline_revision_id").alias("active_baseline_revision_id"), ids.alias("active_extension_revision_ids"),
        _stamp("created_at", now).alias("created_at"), _stamp("updated_at", now).alias("updated_at"),
    )


#: Formats of sources.
FORMATS = ("worldbook_json", "titled_txt")


def normalize_sources(rows: DataFrame, now: int) -> DataFrame:
    """Sources: a known format or unknown, the payload as it is."""
    return rows.select(
        _text("source_id").alias("source_id"), _text("world_id").alias("world_id"), F.when(F.col("format").isin(*FORMATS), F.col("format")).otherwise("unknown").alias("format"), _optional("filename").alias("filename"),
        _text("content_hash").alias("content_hash"), "raw_payload", _stamp("imported_at", now).alias("imported_at"),
    )


def normalize_revisions(rows: DataFrame, now: int) -> DataFrame:
    """Revisions: extension or baseline, a label in any case."""
    return rows.select(
        _text("revision_id").alias("revision_id"), _text("world_id").alias("world_id"), _text("source_id").alias("source_id"), _text("revision_label", "Imported revision").alias("revision_label"),
        F.when(F.col("revision_kind") == "extension", "extension").otherwise("baseline").alias("revision_kind"), _optional("parent_revision_id").alias("parent_revision_id"), _optional("base_revision_id").alias("base_revision_id"),
        _stamp("created_at", now).alias("created_at"),
    )


def baseline_records(sources: DataFrame, most: int = 420, least: int = 18) -> DataFrame:
    """(id, source_type, source_id, title, chunk_index, text, normalized, tokens) of sources (source_type, source_id, title, text).

    A missing type is unknown, a missing id the title or the type, a missing title the id. Chunks without normal text go.
    """
    kind = _text("source_type", "unknown")
    rows = sources.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(kind.alias("source_type"), F.coalesce(_optional("source_id"), _optional("title"), kind).alias("source_id"), _optional("title").alias("title"), F.posexplode(split_chunks(F.col("text"), most, least)).alias("chunk_index", "text"))
    rows = rows.withColumns({"title": F.coalesce("title", "source_id"), "normalized": normalize_baseline(F.col("text"))}).where("normalized <> ''")
    seed = F.concat_ws("|", "source_type", "source_id", "chunk_index", "normalized")
    return rows.select(F.concat(F.lit("b_"), F.left(F.sha2(seed, 256), F.lit(16))).alias("id"), "source_type", "source_id", "title", "chunk_index", "text", "normalized", tokens_baseline(F.col("text")).alias("tokens"))


def for_actor(rows: DataFrame, shown: Column, by: str) -> tuple[DataFrame, DataFrame]:
    """P10: the rows that the actor may see, and per query the ids of those hidden. rows: (<by>, entry_id, ...)."""
    hidden = rows.where(~shown).groupBy(by).agg(F.array_sort(F.collect_set("entry_id")).alias("hidden"))
    return rows.where(shown), hidden


def retrieve(queries: DataFrame, chunks: DataFrame, shown: Column, dense: DataFrame | None = None, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Entries for each query: lexical and dense chunk ranks fused, collapsed to entries, hidden ones taken out.

    dense: (query_id, entry_id, chunk, rank), if there is a dense index. shown may use the chunks' columns.
    """
    ranks = lexical_topk(queries, chunks).select("query_id", "entry_id", "chunk", (F.lit(0.9) / (rrf_k + F.col("rank") + 1)).alias("part"))
    if dense is not None:
        ranks = ranks.unionByName(dense.select("query_id", "entry_id", "chunk", (F.lit(1.0) / (rrf_k + F.col("rank") + 1)).alias("part")))
    scored = ranks.groupBy("query_id", "entry_id", "chunk").agg(F.sum("part").alias("score"))
    entries = collapse_to_entry(scored).join(chunks.where(shown).select("entry_id").distinct(), "entry_id")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "entry_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
