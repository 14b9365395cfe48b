"""Text functions as column expressions: normalising, redacting, chunking, tagging."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
EMAIL_UPPER = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?\d[\s-]?)?(?:\(\d{3}\)|\d{3})[\s-]?\d{3}[\s-]?\d{4}"
SSN = r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"
FOUR_DIGITS = r"\d{4}"  # of both numbers
ENHANCED = [
    (r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", ""), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r" +([,.!?;:])", "$1"), (r"([,.!?;:])([^\s])", "$1 $2"),
    (r"[\u2018\u2019\u2032]", "'"), (r"[\u201C\u201D\u2033]", '"'), (r"[\u2013\u2014\u2015]", "-"), (r"\.{4,}", "..."), (r"\n{4,}", "\n\n\n"),
]
CORRECTIONS = [
    (r"(?i)\bteh\b", "the"), (r"(?i)\badn\b", "and"), (r"(?i)\btha\b", "that"), (r"(?i)\btaht\b", "that"), (r"(?i)\bhte\b", "the"),
    (r"(?i)([a-z])\1{3,}", "$1$1"), (r"(?i)([.!?])([A-Z][a-z])", "$1 $2"),
]
SECTION_ALIASES = {
    "executive summary": "executive_summary", "table of contents": "table_of_contents", "conclusions": "conclusions", "conclusion": "conclusions",
    "abstract": "abstract", "introduction": "introduction", "background": "background",
}
ALL_CAPS, NUMBERED = r"^[A-Z0-9][A-Z0-9 &'\-]{6,}$", r"^(\d+)[\.\)]\s+(.+)$"
# Repeated groups keep what they have taken (++), with the same matches: Java's matcher calls itself for each repeat of a group
# that may give some back, and a long run of words or numbers would overflow the stack and end the executor.
TITLE_CASE = r"^[A-Z][a-z]++(?:\s++[A-Z][a-z]++)++$"
DATES = [
    (r"(?i)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", 1),
    (r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", 1),
    (r"(?i)\b\d{4}-\d{2}-\d{2}\b", 0),
]
AUTHOR = r"(?i)(?:By|Author|Written by|Created by):\s*([A-Z][a-z]++(?:\s++[A-Z][a-z]++)++)"
VERSION = r"(?i)\b(v|version|ver|v\.)\s*(\d++(?:\.\d++\b)++)"

CONTENT = {
    "legal": [r"\b(whereas|hereby|herein|hereinafter|pursuant to|in accordance with)\b", r"\b(agreement|contract|terms|conditions|clause|section)\b", r"\b(party|parties|plaintiff|defendant|court|legal)\b"],
    "regulatory": [
        r"\b(supervisor|auditor|regulator|supervision|regulatory)\b", r"\b(eba|ecb|basel|crr|crd|ssm|pru|fca|sec)\b", r"\b(guidelines|framework|directive|regulation|compliance)\b",
        r"\b(capital|risk|governance|oversight|monitoring)\b", r"\b(principle|requirement|standard|provision)\b", r"\b(whereas|pursuant to|in accordance with|hereinafter)\b",
    ],
    "finance_banking": [
        r"\b(banking|financial|finance|bank|institution)\b", r"\b(capital|liquidity|solvency|credit|market\s+risk)\b", r"\b(asset|liability|balance\s+sheet|income\s+statement)\b",
        r"\b(regulation|compliance|audit|supervision)\b", r"\b(interest\s+rate|yield|portfolio|investment)\b",
    ],
    "code": [r"^\s*(def|class|function|import|from|if|for|while|try|except)\s+", r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[=\(]", r"^\s*#.*$", r"^\s*//.*$", r"^\s*/\*.*\*/$"],
    "documentation": [r"^#{1,6}\s+", r"^\s*\*\s+", r"^\s*\d+\.\s+", r"```", r"\[.*\]\(.*\)"],
    "conversation": [r"^\s*\d{1,2}:\d{2}\s+[AP]M\s+", r"^\s*\[.*\]\s+", r"^\s*<.*>\s+", r"^\s*\w+:\s+"],
    "academic": [r"\b(abstract|introduction|methodology|results|conclusion|references)\b", r"\b(study|research|analysis|hypothesis|findings|implications)\b", r"^\s*\d+\.\d+\s+", r"\[.*\]\s*\(.*\)"],
    "technical": [
        r"\b(API|endpoint|request|response|authentication|authorization)\b", r"\b(database|query|table|index|schema|migration)\b", r"\b(algorithm|optimization|performance|scalability|architecture)\b", r"^\s*```\w*$",
    ],
}
EXTENSIONS = {"code": (0.8, [".py", ".js", ".java", ".cpp", ".c", ".go", ".rs"]), "documentation": (0.6, [".md", ".rst", ".txt"]), "general": (0.5, [".pdf", ".doc", ".docx"])}
HINTED = ["regulatory", "finance_banking", "legal", "academic", "technical"]
TECHNICAL_TERMS, MEDICAL_TERMS = ["api", "sdk", "cli", "config"], ["patient", "diagnosis", "treatment", "medication", "dose"]

STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "this", "that", "these", "those", "it", "its", "as", "not",
]
#: What a text must hold for a pattern of CONTENT that begins a line or spans brackets to match.
HELD = {
    "code": [None, r"[=(]", "#", "//", r"/\*"], "documentation": ["#", r"\*", r"\d\.\s", "```", r"\]\("], "conversation": [":", r"\]", ">", ":"], "academic": [None, None, r"\d\.\d", r"\]\s*\("], "technical": [None, None, None, "```"],
}
MARKS = r"^[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+$"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used: an array of one gives it a name."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def redact_pii(text: Column) -> Column:
    """E-mail addresses, then telephone numbers, then social security numbers."""
    text = bound(text, lambda t: F.when(t.contains("@"), F.regexp_replace(t, EMAIL, "[redacted_email]")).otherwise(t))
    numbers = lambda t: F.regexp_replace(F.regexp_replace(t, PHONE, "[redacted_phone]"), SSN, "[SSN]")
    return bound(text, lambda t: F.when(t.rlike(FOUR_DIGITS), numbers(t)).otherwise(t))


def has_pii(text: Column, parity: bool = False) -> Column:
    """parity: addresses count only in upper case, as the original pattern is searched."""
    numbers = F.when(text.rlike(FOUR_DIGITS), text.rlike(SSN) | text.rlike(PHONE)).otherwise(F.when(text.isNotNull(), F.lit(False)))
    return numbers | F.when(text.contains("@"), text.rlike(EMAIL_UPPER if parity else EMAIL)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def replaced(text: Column, held: str, pattern: str, new: str) -> Column:
    """Matches replaced where the text holds what each of them does: a plain pattern spares most texts the search."""
    return bound(text, lambda t: F.when(t.rlike(held), F.regexp_replace(t, pattern, new)).otherwise(t))


def unwrapped(text: Column) -> Column:
    """Lines rejoined: LF only, no hyphenation across lines, a wrapped line joined to the next, one blank line at most."""
    text = replaced(text, "\r", r"\r\n?", "\n")
    text = replaced(text, "-\n", r"(\w)-\n(\w)", "$1$2")
    text = replaced(text, r"[ \t]{2}|\t", r"[ \t]+", " ")
    text = replaced(text, r"\n[a-z]", r"([^.!?:;\n])\n(?=[a-z])", "$1 ")
    return F.trim(replaced(text, "\n\n\n", r"\n{3,}", "\n\n"))


def normalised(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Ordered replacements, folded into one expression."""
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, text)


def space_ratio(text: Column, chars: int) -> Column:
    head = F.substring(text, 1, chars)
    return F.when(F.length(head) > 0, (F.length(head) - F.length(F.translate(head, " ", ""))) / F.length(head)).otherwise(0.0)


def respaced(text: Column, passes: int = 10) -> Column:
    """Texts with single spaces between characters, put together again."""
    fixed = reduce(lambda t, _: F.regexp_replace(t, r"(?<=\b\w) (?=\w\b)", ""), range(passes), text)
    return F.when(space_ratio(text, 1000) > 0.3, fixed).otherwise(text)


def word_list(text: Column) -> Column:
    """The words between white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words between white space, without a list of them."""
    edge = lambda w: F.when(w == "", 1).otherwise(0)
    return bound(F.split(text, r"\s+"), lambda a: F.size(a) - edge(F.get(a, F.lit(0))) - F.when(F.size(a) > 1, edge(F.get(a, F.size(a) - 1))).otherwise(0))


def token_estimate(text: Column) -> Column:
    """The larger of a quarter of the characters and the number of words."""
    return F.greatest(F.floor(F.length(text) / 4), word_count(text).cast("long"))


def char_chunks(text: Column, max_tokens: int, overlap: int) -> Column:
    """Windows of 4 characters a token; each begins `overlap` tokens before the last one's end."""
    size, stride = 4 * max_tokens, 4 * max(1, max_tokens - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Pieces between a terminator and a capital letter or digit, page marks left out."""
    plain = F.regexp_replace(text, r"===\s*PAGE\s+\d+\s*===", " ")
    parts = F.transform(F.split(plain, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def pages(text: Column) -> Column:
    """array<struct<page, body>> of a text with === PAGE n === marks; one page without."""

    def split(t: Column) -> Column:
        found = F.struct(F.regexp_extract_all(t, F.lit(r"===\s*PAGE\s+(\d+)\s*==="), F.lit(1)).alias("numbers"), F.split(t, r"===\s*PAGE\s+\d+\s*===").alias("bodies"))
        marked = lambda x: F.transform(x["numbers"], lambda n, i: F.struct(n.cast("int").alias("page"), F.trim(x["bodies"][i + 1]).alias("body")))
        return F.when(t.contains("==="), bound(found, lambda x: F.when(F.size(x["numbers"]) > 0, marked(x))))

    whole = lambda t: F.array(F.struct(F.lit(1).alias("page"), F.trim(t).alias("body")))
    return bound(text, lambda t: F.coalesce(split(t), whole(t)))


def slug(title: Column, length: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, length)


def ends_mid_sentence(text: Column) -> Column:
    """For chunks of the pipeline: no closing punctuation, and cut inside a word or short."""
    plain = F.rtrim(text)
    return ~plain.rlike(r"[.!?][\"')\]]*$") & (~plain.rlike(r"\w$") | (F.length(plain) < 20))


def is_fragment(text: Column) -> Column:
    """For chunks on display: begins in lower case or ends without . ! or ?"""
    plain = F.trim(text)
    return plain.rlike(r"^[a-z]") | ~plain.rlike(r"[.!?]$")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def similarity_of_sets(a: Column, b: Column) -> Column:
    """jaccard of arrays without repeats, by one comparison."""
    return bound(F.size(F.array_intersect(a, b)), lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.when(both.isNotNull(), 0.0)))


def keywords(text: Column, stop: list[str] = STOP_WORDS, most: int = 5) -> Column:
    """The longest distinct words over 4 letters, first ones first."""
    plain = F.filter(F.transform(word_list(F.lower(text)), lambda w: F.regexp_replace(w, MARKS, "")), lambda w: (F.length(w) > 4) & ~w.isin(stop))
    numbered = F.transform(F.array_distinct(plain), lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(numbered), 1, most), lambda s: s["w"])


def commonest(words: Column) -> Column:
    """How often the most frequent word occurs: a fold over the sorted words; 0 for none."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state: Column, word: Column) -> Column:
        run = F.when(state["word"] == word, state["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(F.array_sort(words), start, step, lambda state: state["most"])


def low_quality(text: Column) -> Column:
    """Short, dominated by one word, or mostly not letters."""
    words = word_list(F.lower(text))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    return (F.length(F.trim(text)) < 50) | ((F.size(words) > 10) & (commonest(words) > 0.3 * F.size(words))) | (letters < 0.5)


def text_issues(text: Column) -> Column:
    """What is wrong with a chunk by its text, as an array of labels."""
    words = word_list(text)
    return F.array_compact(F.array(
        F.when(F.length(text) < 50, "Too short"), F.when(text.contains("\0"), "Encoding issues"), F.when(F.size(words) < 10, "Too few words"),
        F.when((F.size(words) > 10) & (commonest(words) > 0.3 * F.size(words)), "Repetitive content"),
    ))


def score_issues(starts_cut: Column, ends_cut: Column, confidence: Column, noise: Column, coherence: Column) -> Column:
    """What is wrong with a chunk by its scores from 0 to 100, as an array of labels."""
    return F.array_compact(F.array(
        F.when(starts_cut, "starts_mid_sentence"), F.when(ends_cut, "ends_mid_sentence"), F.when(confidence < 50, "low_confidence"), F.when(noise > 50, "high_noise"),
        F.when(coherence < 50, "low_coherence"),
    ))


def stripped(text: Column) -> Column:
    # from the begin of a run only: a long run within the text is not tried from each of its places
    return F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", "")


def spaced_out(text: Column) -> Column:
    """True for texts over 100 characters whose first 500 are spaces by more than 0.3."""
    return (F.length(text) > 100) & (space_ratio(text, 500) > 0.3)


def enhanced(text: Column) -> Column:
    """Control characters, spacing, quotes, dashes and dots put right; spaced-out texts stay."""
    return F.when(spaced_out(text), text).otherwise(stripped(normalised(text, ENHANCED)))


def corrected(text: Column) -> Column:
    """Common typing errors, letters repeated over three times and missing spaces put right; spaced-out texts stay."""
    return F.when(spaced_out(text), text).otherwise(normalised(text, CORRECTIONS))


def section_name(title: Column) -> Column:
    """The canonical name of a section's title: an alias, or at most 40 of a-z, 0-9 and _; `section` for an empty one."""
    aliases = F.create_map(*[F.lit(x) for pair in SECTION_ALIASES.items() for x in pair])
    name = lambda plain: F.nullif(F.substring(F.regexp_replace(plain, r"[^a-z0-9]+", "_"), 1, 40), F.lit(""))
    return bound(F.lower(F.regexp_replace(stripped(F.coalesce(title, F.lit(""))), r"\s+", " ")), lambda plain: F.coalesce(F.try_element_at(aliases, plain), name(plain), F.lit("section")))


def sections(text: Column, headers: list[str] = ()) -> Column:
    """array<struct<title, name, body>>: the lines between headers, blank ones left out; sections without a line are none.

    A header is a line that one of `headers` matches at its begin, a numbered line, two capitalised words or more, or
    capitals. Before the first one the title is Introduction, as for a text that has no section.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"), stripped), lambda line: line != "")

    def is_header(line: Column) -> Column:
        shape = line.rlike(NUMBERED) | line.rlike(TITLE_CASE) | (line.rlike(ALL_CAPS) & line.rlike(r"\S\s+\S"))
        return reduce(lambda a, p: a | line.rlike(f"^(?:{p})"), headers, shape)

    def between(lines: Column, bounds: Column) -> Column:
        each = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda begin, k: F.struct(begin.alias("begin"), (F.get(bounds, k + 1) - begin - 1).alias("n")))
        return F.transform(
            F.filter(each, lambda x: x["n"] > 0),
            lambda x: F.struct(F.coalesce(F.get(lines, x["begin"] - 1), F.lit("Introduction")).alias("title"), F.array_join(F.slice(lines, x["begin"] + 1, x["n"]), "\n").alias("body")),
        )

    def of(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda line, i: F.when(is_header(line), i + 1)), lambda i: i.isNotNull())
        return bound(F.concat(F.array(F.lit(0)), places, F.array(F.size(lines) + 1)), lambda bounds: between(lines, bounds))

    found = F.transform(bound(lines, of), lambda x: F.struct(x["title"].alias("title"), section_name(x["title"]).alias("name"), x["body"].alias("body")))
    whole = F.array(F.struct(F.lit("Introduction").alias("title"), F.lit("introduction").alias("name"), stripped(text).alias("body")))
    return bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))


def representative(text: Column, chunk: int = 5000, most: int = 20000) -> Column:
    """White space collapsed; of texts over `most` characters a head, a middle and a tail of `chunk` at most."""
    plain = F.regexp_replace(stripped(text), r"\s+", " ")
    part = min(chunk, most // 3)
    middle = F.greatest(F.floor(F.length(plain) / 2).cast("int") - part // 2, F.lit(0))
    cut = F.concat(F.substring(plain, 1, part), F.lit(" === MIDDLE SAMPLE === "), F.substring(plain, middle + 1, F.lit(part)), F.lit(" === END SAMPLE === "), F.right(plain, F.lit(part)))
    return F.when(F.length(plain) <= most, plain).otherwise(F.substring(cut, 1, most))


def found_metadata(text: Column, tags: Column) -> Column:
    """struct<doc_date, tags>: dates, author and versions named in the text, appended to the tags.

    Of a date with the month's name only that name is taken. Three dates of each form, two versions.
    """
    listed = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ",")))

    def told(found: Column) -> Column:
        dates, author = found["dates"], found["author"]
        all_ = F.concat_ws("; ", F.when(tags != "", tags), listed("dates:", F.slice(dates, 1, 3)), F.when(author != "", F.concat(F.lit("author:"), author)), listed("versions:", found["versions"]))
        return F.struct(F.get(dates, F.lit(0)).alias("doc_date"), all_.alias("tags"))

    none = F.array().cast("array<string>")
    few = lambda held, pattern, group, most: F.when(text.rlike(held), F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 1, most)).otherwise(none)
    dates = F.concat(*[few(held, p, g, 3) for held, (p, g) in zip([r"\d[/-]\d", FOUR_DIGITS, r"\d{4}-\d"], DATES, strict=True)])
    author = F.when(text.contains(":"), F.regexp_extract(text, AUTHOR, 1)).otherwise("")
    return bound(F.struct(dates.alias("dates"), author.alias("author"), few(r"\d\.\d", VERSION, 2, 2).alias("versions")), told)


def cleaned(text: Column, max_chars: int) -> Column:
    """Without control characters, white space collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\s+", " ")), 1, max_chars)


def leading(pattern: str) -> list[str]:
    """The words of which a pattern of whole words, or of words that begin a line, needs one."""
    inner = re.fullmatch(r"\\b\((.*)\)\\b|\^\\s\*\((.*)\)\\s\+", pattern)
    return [re.match("[a-z0-9]+", w.lower())[0] for w in (inner[1] or inner[2]).split("|")] if inner else []


def pattern_share(text: Column, patterns: list[str], possible: list[Column]) -> Column:
    """The mean over patterns of the matches in a thousand characters, each at most 1; only a possible one is counted."""
    counted = lambda p, held: F.when(F.coalesce(held, F.lit(True)), F.regexp_count(text, F.lit(p))).otherwise(0)
    return reduce(lambda a, b: a + b, [F.least(counted(p, held) / (F.greatest(F.length(text), F.lit(1)) / F.lit(1000.0)), F.lit(1.0)) for p, held in zip(patterns, possible, strict=True)]) / len(patterns)


def content_type(text: Column, extension: Column, hint: Column) -> Column:
    """struct<kind, confidence>: the kind of content with the largest share of patterns; general at 0.3 for none.

    A file's extension stands in for a kind without a match and comes first among equals. A hint wins at 0.6 where no
    kind reaches 0.5, and adds 0.2 to its kind otherwise.
    """
    ext, wish = F.lower(F.coalesce(extension, F.lit(""))), F.lower(F.coalesce(hint, F.lit("")))
    every = sorted({w for patterns in CONTENT.values() for p in patterns for w in leading(p)})

    def entry(name: str, place: int, text: Column, words: Column) -> Column:
        share = F.lit(0.0)
        if name in CONTENT:
            held = [F.arrays_overlap(words, F.array(*map(F.lit, leading(p)))) if leading(p) else text.rlike(HELD[name][k]) for k, p in enumerate(CONTENT[name])]
            share = pattern_share(text, [f"(?imd){p}" for p in CONTENT[name]], held)
        confidence, endings = EXTENSIONS.get(name, (0.0, ["-"]))
        return F.struct(share.alias("share"), F.when(ext.isin(endings), confidence).otherwise(0.0).alias("prior"), F.lit(-place).alias("place"), F.lit(name).alias("kind"))

    def scored(k: Column) -> Column:
        score = F.when(k["share"] > 0, k["share"]).otherwise(k["prior"])
        return F.struct(score.alias("score"), F.when(k["prior"] > 0, 1).otherwise(k["place"]).alias("place"), k["kind"].alias("kind"))

    def hinted(k: Column, weak: Column) -> Column:
        told = wish.isin(HINTED) & (k["kind"] == wish)
        score = F.when(told & weak, F.greatest(k["score"], F.lit(0.6))).when(told & (k["score"] > 0), F.least(k["score"] + 0.2, F.lit(1.0))).otherwise(k["score"])
        return F.struct(score.alias("score"), k["place"].alias("place"), k["kind"].alias("kind"))

    def named(best: Column) -> Column:
        found = best["score"] > 0
        return F.struct(F.when(found, best["kind"]).otherwise("general").alias("kind"), F.when(found, best["score"]).otherwise(0.3).alias("confidence"))

    # The words of the text that begin some match are found once; most texts hold few of them.
    met = lambda t: F.filter(F.split(F.lower(t), "[^a-z0-9_]+"), lambda w: w.isin(every))
    kinds = bound(text, lambda t: bound(met(t), lambda words: F.array(*[entry(name, place, t, words) for place, name in enumerate([*CONTENT, "general"])])))
    best = bound(F.transform(kinds, scored), lambda all_: bound(F.array_max(all_)["score"] < 0.5, lambda weak: F.array_max(F.transform(all_, lambda k: hinted(k, weak)))))
    return bound(best, named)


def chunk_sizes(text: Column, size: int, overlap: int, least: int, most: int) -> Column:
    """struct<size, overlap> in tokens, adjusted to the length of sentences and of the text, between least and most."""
    parts = F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s, F.lit(" \n\t\r")) != "")
    scaled = lambda n, by: F.floor(n * F.lit(by)).cast("int")

    def sized(known: Column) -> Column:
        words, mean = known["words"], F.coalesce(F.try_divide(known["words"], known["parts"]), F.lit(0.0))
        by_sentence = lambda n: F.when(mean > 30, scaled(F.lit(n), 1.2)).when(mean < 15, scaled(F.lit(n), 0.8)).otherwise(n)
        first = F.when(words < 100, F.least(by_sentence(size), words * 4)).when(words > 10000, scaled(by_sentence(size), 1.1)).otherwise(by_sentence(size))
        lap = F.when(words < 100, F.least(by_sentence(overlap), F.floor(first / 4).cast("int"))).when(words > 10000, scaled(by_sentence(overlap), 1.1)).otherwise(by_sentence(overlap))
        final = F.greatest(F.lit(least), F.least(first, F.lit(most)))
        return F.struct(final.alias("size"), F.least(lap, final - 1).alias("overlap"))

    return bound(F.struct(word_count(text).alias("words"), F.size(parts).alias("parts")), sized)


def synthetic_queries(text: Column, style: str, most: int, shortest: int = 10, longest: int = 50) -> Column:
    """Questions after the first sentences of a text, in one of the styles technical, academic, clinical and general."""
    chars, enough = {"technical": (20, 5), "academic": (30, 8), "clinical": (25, 6)}.get(style, (20, 5))
    capital = lambda w: w.rlike(r"^\p{Lu}")

    def question(words: Column) -> Column:
        first = lambda test: F.get(F.filter(words, test), F.lit(0))
        about = lambda before, term, after="?": F.concat(F.lit(before), term, F.lit(after))
        if style == "technical":
            return F.coalesce(about("What is ", first(lambda w: capital(w) | F.lower(w).isin(TECHNICAL_TERMS))), about("How does ", F.get(words, F.lit(0)), " work?"))
        if style == "academic":
            return F.coalesce(about("What are the findings on ", first(capital)), about("What does the research show about ", F.get(words, F.lit(3))))
        if style == "clinical":
            return F.coalesce(about("What is the ", first(lambda w: F.lower(w).isin(MEDICAL_TERMS))), F.lit("What are the clinical indications?"))
        return about("What is ", F.get(words, F.lit(0)))

    sentences = F.slice(F.filter(F.transform(F.split(text, r"\."), stripped), lambda s: F.length(s) > chars), 1, most)
    spoken = F.filter(F.transform(sentences, word_list), lambda w: F.size(w) > enough)
    return F.filter(F.transform(spoken, question), lambda q: F.length(q).between(shortest, longest))


def chunk_record(stem: Column, page: Column, title: Column, text: Column, index: Column, count: Column) -> Column:
    """The record of a chunk: its id, place, section, text and estimated tokens; scopes of the document and the field."""
    name = section_name(title)
    return F.struct(
        F.concat(stem, F.lit("_p"), page.cast("string"), F.lit("_s"), name, F.lit("_c"), index.cast("string")).alias("chunk_id"), stem.alias("document_id"), page.alias("page"), title.alias("section_raw"),
        name.alias("section"), name.alias("field_name"), text.alias("text"), token_estimate(text).alias("token_est"), index.alias("chunk_index"), count.alias("chunk_of"), stem.alias("doc_scope"), name.alias("field_scope"),
        F.lit("").alias("tags"), F.lit(None).cast("string").alias("doc_date"),
    )
