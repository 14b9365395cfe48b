"""From raw documents to chunk records in one plan without a shuffle.

Lines are rejoined, personal data masked, pages normalised, and the text put right as a row's flags ask. The chunk settings
of every document are then resolved from what its row gives: settings by hand, settings resolved before, those of the kind of
content that is detected, or its playbook's. Pages and sections become rows, and each row is chunked by its own strategy.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import scores as sc
from loomwright.functions import text as tx
from loomwright.operators.chunkers import chunks

# The chunk settings of playbooks (strategy, tokens, sentences that overlap, characters that overlap) and of
# kinds of content (size, overlap, least, most, strategy), the names of strategies, defaults, and a page's normalisers.
PLAYBOOKS = {
    "academic": ("sentence", 1000, 2, 250),
    "ecommerce": ("fixed_size", 800, 1, 150),
    "financial": ("sentence", 1500, 2, 350),
    "healthcare": ("sentence", 1200, 2, 300),
    "legal": ("sentence", 1800, 2, 400),
    "regulatory": ("sentence", 900, 2, 300),
    "retail": ("fixed_size", 900, 1, 200),
    "scanned": ("sentence", 900, 2, 300),
    "tech": ("sentence", 800, 1, 240),
}
KINDS = {
    "legal": (1200, 240, 200, 2000, "semantic"),
    "regulatory": (1400, 280, 200, 2200, "semantic"),
    "finance_banking": (1300, 260, 200, 2000, "semantic"),
    "code": (900, 180, 100, 1500, "recursive"),
    "documentation": (800, 160, 100, 1500, "paragraph_boundary"),
    "conversation": (700, 140, 50, 1200, "sentence_boundary"),
    "academic": (1200, 240, 150, 2000, "semantic"),
    "technical": (800, 160, 100, 1500, "semantic"),
    "general": (1000, 200, 100, 2000, "fixed_size"),
}
STRATEGIES = {"fixed_size": "char", "semantic": "paragraph", "paragraph_boundary": "paragraph", "sentence": "sentence", "sentence_boundary": "sentence", "recursive": "sentence"}
SIZE, OVERLAP, STRATEGY, CONFIDENCE, HEAD, MOST, CAPPED = 1000, 200, "fixed_size", 0.7, 20_000, 10_000, 4000
NORMALISERS = [(r"­", ""), (r"(?m)([A-Za-z])-[ \t]*\r?\n[ \t]*([A-Za-z])", "$1$2"), (r"(?m)\r?\n(?=[a-z])", " ")]
#: What a text must hold for a normaliser to match.
HELD = ["\u00ad", r"-[ \t]*\r?\n", r"\n[a-z]"]

#: What a document's row may say of its settings; each may be null.
GIVEN = {
    "mode": "string", "manual_size": "int", "manual_overlap": "int", "manual_strategy": "string", "resolved_size": "int", "resolved_overlap": "int", "resolved_strategy": "string", "resolved_kind": "string",
    "resolved_confidence": "double", "threshold": "double", "playbook": "string", "extension": "string", "enhance": "boolean", "correct": "boolean",
}


def chosen(value: Column, table: Mapping[str, object]) -> Column:
    """What a fixed table has for a value; null for others."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value]


def playbook_name(given: Column, known: Mapping[str, object] = PLAYBOOKS, default: str = "tech") -> Column:
    """A playbook by name, without case; else by its letters without - _ and spaces; else the default."""
    plain = F.lower(F.trim(given))
    bare = {k.replace("-", "").replace("_", "").replace(" ", ""): k for k in known}
    return F.coalesce(F.when(plain.isin(list(known)), plain), chosen(F.regexp_replace(plain, "[-_ ]+", ""), bare), F.lit(default))


def playbook_settings(name: Column) -> Column:
    """struct<strategy, tokens, sentences, characters> of a playbook."""
    table = reduce(lambda e, kv: e.when(name == kv[0], F.struct(*[F.lit(v).alias(k) for k, v in zip(("strategy", "tokens", "sentences", "characters"), kv[1], strict=True)])), PLAYBOOKS.items(), F.when(F.lit(False), F.lit(None)))
    return table


def hint_of(given: Column) -> Column:
    """The kind of content that the name of a playbook, as it was given, hints at; null for none."""
    low = F.lower(given)
    named = reduce(lambda e, w: e.when(low.contains(w[0]), w[1]), [("regulatory", "regulatory"), ("finance", "finance_banking"), ("banking", "finance_banking"), ("legal", "legal"), ("academic", "academic"), ("technical", "technical")], F.when(low == "reg", "regulatory"))
    return named.when(low == "tech", "technical")


def detected_settings(text: Column, extension: Column, hint: Column) -> Column:
    """struct<kind, confidence, size, overlap, strategy> by the head of a text, with a hint at its kind."""
    head = F.substring(text, 1, HEAD)

    def sized(found: Column) -> Column:
        row = lambda k: chosen(found["kind"], {kind: values[k] for kind, values in KINDS.items()})
        sizes = tx.chunk_sizes(head, row(0), row(1), row(2), row(3))
        return F.struct(found["kind"].alias("kind"), found["confidence"].alias("confidence"), sizes["size"].alias("size"), sizes["overlap"].alias("overlap"), row(4).alias("strategy"))

    return tx.bound(tx.content_type(head, extension, hint), sized)


def resolved_settings(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with GIVEN, and settings: struct<source, strategy, kind, confidence, met, size, overlap, tokens, sentences, characters>.

    By hand (mode manual): its size, overlap and strategy, each else the playbook's, or 200 for the overlap. Automatic, also
    without a mode: what was resolved before, which below the threshold of confidence falls back on windows of a general
    kind; else what is detected; what is set by hand replaces either. Any other mode: the playbook's. An overlap is below its
    size, sizes above 10,000 are 4000.
    """
    c = F.col
    docs = docs.withColumn("__hint", hint_of(c("playbook"))).withColumn("playbook", playbook_name(c("playbook"))).withColumn("__p", playbook_settings(c("playbook")))
    auto = F.coalesce(c("mode"), F.lit("auto")) == "auto"
    before = auto & F.coalesce(c("resolved_size"), c("resolved_overlap"), c("resolved_strategy"), c("resolved_kind"), c("resolved_confidence")).isNotNull()
    docs = docs.withColumn("__d", F.when(auto & ~before, detected_settings(c(text), c("extension"), c("__hint"))))
    threshold = F.coalesce("threshold", F.lit(CONFIDENCE))
    low = before & F.coalesce(c("resolved_confidence") < threshold, F.lit(False))
    positive = lambda v: F.when(v > 0, v)
    size = F.coalesce(positive(c("manual_size")), F.when(before, F.coalesce(positive(c("resolved_size")), F.lit(SIZE))).otherwise(c("__d.size")))
    lap = F.coalesce(c("manual_overlap"), F.when(before, F.coalesce(F.when(c("resolved_overlap") >= 0, c("resolved_overlap")), F.lit(OVERLAP))).otherwise(c("__d.overlap")))
    lap = F.when(lap < 0, OVERLAP).otherwise(lap)
    lap = F.when(before & (lap >= size), F.greatest(size - 1, F.lit(0))).otherwise(lap)
    text_of = lambda v: F.nullif(v, F.lit(""))
    way = F.coalesce(text_of(c("manual_strategy")), F.when(low, STRATEGY).when(before, F.coalesce(text_of(c("resolved_strategy")), F.lit(STRATEGY))).otherwise(c("__d.strategy")))
    kind = F.when(low, "general").when(before, F.coalesce("resolved_kind", F.lit("general"))).otherwise(c("__d.kind"))
    mapped = lambda name: F.coalesce(chosen(F.lower(name), STRATEGIES), c("__p.strategy"))
    confidence = F.when(before, F.coalesce("resolved_confidence", F.when(low, 0.0).otherwise(0.5))).otherwise(c("__d.confidence"))

    def settings(source: str, strategy: Column, size: Column, overlap: Column, tokens: Column, sentences: Column, characters: Column, kind: Column, confidence: Column, met: Column) -> Column:
        values = {"source": F.lit(source), "strategy": strategy, "kind": kind, "confidence": confidence.cast("double"), "met": met.cast("boolean"), "size": size, "overlap": overlap, "tokens": tokens, "sentences": sentences, "characters": characters}
        return F.struct(*[(v.cast("int") if k in ("size", "overlap", "tokens", "sentences", "characters") else v).alias(k) for k, v in values.items()])

    few = lambda overlap: F.greatest(F.lit(1), F.floor(overlap / 20))
    none = F.lit(None)
    by_hand, hand_lap = F.coalesce("manual_size", "__p.tokens"), F.coalesce("manual_overlap", F.lit(OVERLAP))
    manual = settings("manual", mapped(F.coalesce("manual_strategy", "__p.strategy")), by_hand, hand_lap, by_hand, few(hand_lap), hand_lap * 4, c("resolved_kind"), none, none)
    tokens = F.when(size > MOST, CAPPED).otherwise(size)
    automatic = settings("product_auto", mapped(way), size, lap, tokens, few(lap), F.when(lap > 0, lap * 4).otherwise(300), kind, confidence, F.when(before, ~low))
    plain = settings("playbook_default", F.lower("__p.strategy"), c("__p.tokens"), c("__p.sentences") * 20, c("__p.tokens"), c("__p.sentences"), c("__p.characters"), c("resolved_kind"), none, none)
    found = F.when(c("mode") == "manual", manual).when(auto, automatic).otherwise(plain)
    return docs.withColumn("settings", found).drop("__p", "__d", "__hint")


def cleaned_pages(text: Column, enhance: Column, correct: Column) -> Column:
    """array<struct<page, body>> of a raw text: unwrapped, masked, normalised and put right; pages without content are left out."""
    steps = [(held, *step) for held, step in zip(HELD, NORMALISERS, strict=True)]
    tidy = lambda body: tx.bound(reduce(lambda t, step: tx.replaced(t, *step), steps, body), lambda t: tx.respaced(t))
    fenced = lambda pages: F.array_join(F.transform(pages, lambda p: F.concat(F.lit("\n=== PAGE "), p["page"].cast("string"), F.lit(" ===\n"), tidy(p["body"]))), "\n")
    right = lambda t: tx.bound(F.when(enhance, tx.enhanced(t)).otherwise(t), lambda u: F.when(correct, tx.corrected(u)).otherwise(u))
    whole = tx.bound(tx.pages(tx.redact_pii(tx.unwrapped(text))), fenced)
    return F.filter(tx.pages(tx.bound(whole, right)), lambda p: p["body"].rlike(r"\S"))


def sections_of(docs: DataFrame) -> DataFrame:
    """A row for each section with content of each page of docs (doc_id, stem, text, GIVEN): settings, page, title and body.

    A null text, or one that is blank after cleaning, has no rows.
    """
    flags = [F.coalesce(f, F.lit(False)) for f in ("enhance", "correct")]
    # Outer explodes: a filter on the arrays would be pushed below and compute them a second time.
    pages = docs.where("text is not null").withColumn("__pages", cleaned_pages(F.col("text"), *flags))
    whole = F.array_join(F.transform("__pages", lambda p: p["body"]), "\n")
    known = resolved_settings(pages.withColumn("__whole", whole), "__whole")
    paged = known.select("doc_id", "stem", "settings", F.explode_outer("__pages").alias("p")).where("p is not null")
    paged = paged.select("doc_id", "stem", "settings", "p.page", F.posexplode_outer(tx.sections(F.col("p.body"))).alias("section_no", "s"))
    return paged.where(F.col("s.body").rlike(r"\S")).select("doc_id", "stem", "settings", "page", "section_no", F.col("s.title").alias("title"), F.col("s.body").alias("body"))


def chunk_records(docs: DataFrame, audiences: list[tuple[str, str]] = ()) -> DataFrame:
    """The records of every chunk of docs (doc_id, stem, text, GIVEN); names in GIVEN that docs lacks count as null.

    A record has the chunk's id, place, text and estimated tokens, audience, noise, kind of content, dates, author and
    versions found in it, and whether it ends within a sentence. Rows that repeat give their records again.
    """
    from loomwright.operators.chunks import audience

    docs = docs.select("doc_id", "stem", "text", *[(F.col(n) if n in docs.columns else F.lit(None)).cast(k).alias(n) for n, k in GIVEN.items()])
    s = lambda name: F.col(f"settings.{name}")
    cut = sections_of(docs).withColumn("chunks", chunks(F.col("body"), s("strategy"), s("tokens"), s("sentences"), s("characters")))
    # Outer, as above: no section is without a chunk, and a filter that says so would be pushed below and cut every text twice.
    rows = cut.select("doc_id", "stem", "settings", "page", "title", F.size("chunks").alias("n"), F.posexplode_outer("chunks").alias("i", "chunk"))
    text = F.col("chunk")
    record = tx.chunk_record(F.col("stem"), F.col("page"), F.col("title"), text, F.col("i"), F.col("n"))
    told = audience(text, list(audiences)) if audiences else F.lit("general")
    out = rows.select("doc_id", record.alias("r"), s("kind").alias("domain_type"), s("source").alias("config_source"), s("strategy").alias("strategy"), tx.ends_mid_sentence(text).alias("mid_sentence"), told.alias("audience"), sc.noise_percent(text).alias("noise_score"), tx.found_metadata(text, F.lit("")).alias("m"))
    fields = ["chunk_id", "document_id", "page", "section_raw", "section", "field_name", "text", "token_est", "chunk_index", "chunk_of", "doc_scope", "field_scope"]
    return out.select("doc_id", *[F.col(f"r.{f}").alias(f) for f in fields], "domain_type", "config_source", "strategy", "mid_sentence", "audience", "noise_score", "m.doc_date", "m.tags")


def document_stats(records: DataFrame) -> DataFrame:
    """(doc_id, sections, chunks, mid_sentence_ends, tokens) of chunk records."""
    return records.groupBy("doc_id").agg(
        F.count_distinct("page", "section_raw").alias("sections"), F.count(F.lit(1)).alias("chunks"), F.count_if("mid_sentence").alias("mid_sentence_ends"), F.sum("token_est").alias("tokens")
    )


def scored_chunks(records: DataFrame) -> DataFrame:
    """records with their base scores, coherence, freedom from noise and trust: the C scores over chunks."""
    text, words = F.col("text"), F.col("__words")
    parts = {
        "Accuracy": F.lit(85.0), "Secure": sc.secure(text), "Quality": sc.readability(text, words), "Completeness": sc.completeness(words), "Context_Quality": sc.context_quality(text, words), "KnowledgeBase_Ready": sc.knowledge_base_ready(text, words),
        "Metadata_Presence": sc.metadata_presence(F.lit("internal"), F.col("section"), F.col("audience"), F.col("doc_date"), F.col("field_name"), F.col("document_id")),
        "Avg_Chunk_Coherence": sc.coherence(tx.sentences(text), text, single=1.0), "Avg_Noise_Free_Score": F.round(100 - F.col("noise_score"), 2),
    }
    scored = records.withColumn("__words", tx.word_count(text)).withColumns(parts).drop("__words")
    return scored.withColumn("AI_Trust_Score", sc.trust({k: F.col(k) for k in parts}, sc.WEIGHTS))
