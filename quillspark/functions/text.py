"""Text columns: normalising, tokens, stems, references, segments. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, keep: str = r"a-z0-9\s-", drop: bool = False, least: int = 2, stop: list[str] | None = None) -> Column:
    """Lower-case tokens of at least ``least`` characters. Characters outside ``keep`` become spaces, or go if ``drop``."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{keep}]", "" if drop else " ")
    out = F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) >= least)
    return F.filter(out, lambda t: ~t.isin(stop)) if stop else out


def letters(text: Column, least: int = 2) -> Column:
    """Tokens of letters of any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "), " "), lambda t: F.length(t) >= least)


def normalized(text: Column) -> Column:
    """Lower case, other than ``a-z0-9-`` as spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\-\s]", " "), r"\s+", " "))


def respelled(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole words replaced in order, whatever their case."""
    return reduce(lambda c, p: F.regexp_replace(c, rf"(?i)\b{p[0]}\b", p[1]), pairs, text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def contains_to_word_end(text: Column, needle: Column) -> Column:
    """Whether the first place of the needle, both normalised, ends where a word does."""
    t, n = normalized(text), normalized(needle)
    at = F.instr(t, n)
    after = F.substring(t, at + F.length(n), F.lit(1))
    return (at > 0) & ((after == "") | (after == " "))


def segments(text: Column, words: int) -> Column:
    """The text in pieces of so many words; the last may be shorter. No word: no piece."""
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    n = F.size(w)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / words).cast("int")), lambda i: F.array_join(F.slice(w, i * words + 1, words), " "))).otherwise(F.array().cast("array<string>"))


# Endings that are cut, the first that fits.
ENDINGS = ("ing", "eth", "ness", "tion", "tions", "ed", "es")


def short_stem(token: Column) -> Column:
    """Cuts one common ending, whatever is left; a final s only from more than three letters."""
    out = F.when(token.endswith("s") & (F.length(token) > 3), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    for ending in reversed(ENDINGS):
        out = F.when(token.endswith(ending), F.substring(token, F.lit(1), F.length(token) - len(ending))).otherwise(out)
    return out


# The ways of splitting a text into tokens: characters kept, whether the others go or become spaces, least length.
TOKENIZERS = {"weights": (r"a-z0-9\-\s", True, 2), "coverage": (r"a-z0-9\-\s", False, 2), "transport": (r"a-z0-9\s'-", False, 2), "bigrams": (r"a-z\s", True, 2), "labels": (r"a-z\s", False, 3), "matcher": (r"a-z0-9\s\-'", True, 2)}
# Words that the phrase matcher passes over.
PASSED_OVER = "the a an and or of to in for on with by at from as is was were be been being have has had having do does did doing but so if then else when where which while upon".split()


def tokens_of(kind: str, text: Column) -> Column:
    """Tokens in one of the TOKENIZERS' ways; ``matcher`` passes over stop words; ``signs`` splits at punctuation of any script."""
    if kind == "signs":
        return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{P}$+<=>^`|~]", " "), r"\s+"), lambda t: t != "")
    keep, drop, least = TOKENIZERS[kind]
    return tokens(text, keep, drop, least, PASSED_OVER if kind == "matcher" else None)


def paired_segments(a: Column, b: Column, words: int = 150) -> Column:
    """Two texts in pieces of so many words, as ``array<struct<a, b>>``; the shorter is filled up with empty pieces."""
    empty = lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit("")))
    return F.transform(F.arrays_zip(empty(segments(a, words)).alias("a"), empty(segments(b, words)).alias("b")), lambda p: F.struct(F.coalesce(p["a"], F.lit("")).alias("a"), F.coalesce(p["b"], F.lit("")).alias("b")))


def untagged(text: Column) -> Column:
    """Text of a tagged translation: notes and numbers go with their tags, words inside tags stay, breaks become spaces."""
    for pattern, new in ((r"<RF>[^<]*<Rf>", ""), (r"<WT>[^<]*<Wt>", ""), (r"<WH>([^<]*)<Wh>", "$1"), (r"<FI>([^<]*)<Fi>", "$1"), (r"<FO>([^<]*)<Fo>", "$1"), (r"<C[LM]>", " "), (r"<[^>]+>", ""), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def plain_summary(text: Column) -> Column:
    """A summary without leading header lines, links, emphasis and bullets; null if nothing is left.

    A header is wrapped in markers, begins with #, or is a line of twelve words at most without an end of sentence.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    header = lambda x: x.rlike(r"^\*+.*\*+$|^_+.*_+$|^`.*`$|^~+.*~+$|^#+\s*") | ((F.size(F.split(x, r"\s+")) <= 12) & ~x.rlike("[.!?]"))
    first = F.array_position(F.transform(lines, lambda x: ~header(x)), True).cast("int")
    rest = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), " ")
    for pattern, new in ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[*_`~]+", ""), (r"(?m)^\s*[-•]\s*", ""), (r"\s+", " ")):
        rest = F.regexp_replace(rest, pattern, new)
    rest = F.trim(rest)
    return F.when((first > 0) & (rest != ""), rest)


def gloss_words(text: Column) -> Column:
    """The words of a gloss list: notes in brackets and numbers of references go, what is left is split at signs, filler words are dropped."""
    for pattern, new in ((r"\[[^\]]*\]", ""), (r"\([-–—][^)]*\)", ""), (r"\([^)]*\)", ""), (r"H\d+|G\d+", ""), (r"(?i)Compare[^,;]*", ""), (r"[;.!?]", ",")):
        text = F.regexp_replace(text, pattern, new)
    each = F.transform(F.split(text, r",\s*"), lambda w: F.regexp_replace(F.regexp_replace(F.lower(F.trim(w)), r"^x\s+", ""), r"\s+", " "))
    return F.filter(each, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$|^(or|and|also|as|by|in|of|the|to|a|an)$"))


def fragment(words: Column, seed: Column) -> Column:
    """Four to seven words in a row of a text's content words, from a place that the seed picks; null without words.

    ``words`` are the text's; content words have four letters or more; where there are fewer than four of them, words of three letters count.
    """
    content, short = F.filter(words, lambda w: F.length(w) >= 4), F.filter(words, lambda w: F.length(w) >= 3)
    source = F.when(F.size(content) >= 4, content).otherwise(short)
    width = F.greatest(F.lit(3), F.least(F.size(source), (4 + F.pmod(seed, F.lit(4))).cast("int")))
    start = F.pmod(F.floor(seed / 4), F.greatest(F.size(source) - width, F.lit(0)) + 1).cast("int")
    return F.when(F.size(source) > 0, F.array_join(F.slice(source, start + 1, width), " "))


def reference(text: Column, books: dict[str, str]) -> Column:
    """``book c:v``, ``book c v`` or ``book c`` as struct(book, chapter, verse), the book's short name written out; else null.

    The form with a space needs a known short name.
    """
    names = F.create_map(*[F.lit(x) for p in books.items() for x in (p[0].lower(), p[1])])
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i)
    spaced, colon, plain = r"^(.+?)\s+(\d+)\s+(\d+)$", r"^(.+?)\s+(\d+):(\d+)$", r"^(.+?)\s+(\d+)$"
    known = lambda p: F.element_at(names, F.lower(part(p, 1)))
    made = lambda p, b, v: F.struct(b.alias("book"), part(p, 2).cast("int").alias("chapter"), (part(p, 3).cast("int") if v else F.lit(None).cast("int")).alias("verse"))
    full = lambda p: F.coalesce(known(p), part(p, 1))
    return F.when(t.rlike(spaced) & known(spaced).isNotNull(), made(spaced, known(spaced), True)).when(t.rlike(colon), made(colon, full(colon), True)).when(t.rlike(plain), made(plain, full(plain), False))


def stripped(html: Column) -> Column:
    """Text of markup: scripts, styles, comments and tags gone, common entities decoded, single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sentences(text: Column, least: int = 50, most: int = 180) -> Column:
    """Sentences after the first, of a length between the bounds."""
    all_ = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]\s+"), lambda s: F.trim(s))
    return F.filter(F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0))), lambda s: F.length(s).between(least, most))


def token_hash(token: Column, buckets: int = 30_000, first: int = 1_000) -> Column:
    """A number for an unknown token: 31 * h + code over its characters, as a 32-bit integer, folded into the buckets."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(2**32)))
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.abs(signed) % buckets + first


def dice(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
