"""Text cleaning, parsing and scoring as columns."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Letters of the most frequent English function words; a text is taken for English by their share.
ENGLISH_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "are", "be", "this", "have", "or", "not")


# What cleaning takes out, in this order, and the text without which a pattern can't match.
TAGS, URLS, EMAILS = (r"<[^>]+>", ("<",)), (r"https?://\S+|www\.\S+", ("http", "www.")), (r"\S+@\S+\.\S+", ("@",))
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f]"


#: What `html.unescape` looks at, a reference at a time.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _unescaped(references: pd.Series) -> pd.Series:
    return references.map(lambda found: [html.unescape(r) for r in found], na_action="ignore")


def decoded(text: Column) -> Column:
    """text with its character references decoded, null where it has no &.  Only the references go to Python; texts stay in the JVM."""
    marked = F.when(F.contains(text, F.lit("&")), text)
    meant = _unescaped(F.regexp_extract_all(marked, F.lit(REFERENCE), F.lit(0)))
    between = F.split(marked, REFERENCE, -1)
    return F.array_join(F.zip_with(between, meant, lambda before, sign: F.concat(before, F.coalesce(sign, F.lit("")))), "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f reads it."""
    return F.get(F.transform(F.array(value), f), 0)


def _without(pattern: str, signs: Sequence[str]) -> Callable[[Column], Column]:
    def taken_out(t: Column) -> Column:
        found = reduce(Column.__or__, (F.contains(t, F.lit(sign)) for sign in signs))
        return F.when(found, F.regexp_replace(t, pattern, " ")).otherwise(t)

    return taken_out


def clean_text(text: Column, entities: bool = True) -> Column:
    """Entities, tags, URLs, e-mails and control characters out (each a space), white space collapsed; null gives ''.

    Only the references of texts with an & go to Python; everything else is native, and a pattern runs only where its text can be.
    """
    out = F.coalesce(text, F.lit(""))
    if entities:
        out = F.coalesce(decoded(text), out)
    for pattern, signs in (TAGS, URLS, EMAILS):
        out = let(out, _without(pattern, signs))
    out = F.regexp_replace(out, CONTROLS, " ")
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))


def norm_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", "")


def norm_text_hash(text: Column) -> Column:
    return F.sha1(norm_text(text))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 16 hex digits of the SHA-1 of the joined parts; a null part counts as 'anon'."""
    whole = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("anon")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(whole), 1, 16))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def ts_seconds(ts: Column, low: int = 946684800, high: int = 1893456000) -> Column:
    """Unix seconds from seconds or milliseconds; null outside the bounds."""
    seconds = F.when(ts > 10_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("bigint")
    return F.when(seconds.between(low, high), seconds)


def rating_or_null(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    return F.when(number.between(1.0, 5.0), number)


def price_or_null(value: Column, low: float = 0.5, high: float = 5000.0) -> Column:
    number = F.regexp_replace(value, "[$,]", "").try_cast("double")
    return F.when(number.between(low, high), number)


def ascii_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1)).cast("double")


def english_share(text: Column, cut: int = 400, words: Sequence[str] = ENGLISH_WORDS) -> Column:
    """Share of English function words among the words of the first `cut` characters."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.substring(text, 1, cut)), r"[^a-z]+", " ")), " ")
    hits = F.size(F.filter(tokens, lambda w: w.isin(*words)))
    return hits / F.size(tokens).cast("double")


def is_english(text: Column, least: float = 0.1) -> Column:
    return (ascii_ratio(text) >= 0.85) & (english_share(text) >= least)


def release_ts(text: Column, fallback: Column) -> Column:
    """Seconds of 'Feb 26, 2015' or 'February 26, 2015' (UTC), else the fallback."""
    parsed = [F.unix_timestamp(F.try_to_timestamp(text, F.lit(f))) for f in ("MMM d, yyyy", "MMMM d, yyyy")]
    return F.coalesce(*parsed, fallback)


def monetization(free: Column, in_app: Column) -> Column:
    return F.when(free & ~in_app, "free").when(free, "freemium").otherwise("paid")


def launch_spec(brand: Column, name: Column, features: Column) -> Column:
    return F.concat(brand, F.lit(" "), F.substring(name, 1, 120), F.lit(": "), F.substring(F.array_join(features, " | "), 1, 2500))


def short_name(name: Column, brand: Column) -> Column:
    """Names over 38 characters end before the first of , | – — ( ) if 5 characters remain; short ones get their brand."""
    head = F.trim(F.element_at(F.split(name, r"[,|–—()]"), 1))
    cut = F.when(F.length(name) <= 38, name).when(F.length(head) >= 5, head).otherwise(F.substring(name, 1, 38))
    lacks = (F.length(cut) < 15) & ~F.contains(F.lower(cut), F.lower(brand))
    return F.substring(F.when(lacks, F.concat(brand, F.lit(" "), cut)).otherwise(cut), 1, 42)


def months_apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (86400 * 30.44)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def phrase_pattern(phrases: Sequence[str]) -> str:
    """A regular expression that finds the first place of any of the phrases in one pass: phrases share their beginnings, so a
    character that begins none ends the search at its place, however many phrases there are.  Without phrases it finds nothing."""

    def branch(rests: set[str]) -> str:
        if "" in rests:
            return ""  # a phrase ends here: longer ones need not be told apart
        heads: dict[str, set[str]] = {}
        for r in sorted(rests):
            heads.setdefault(r[0], set()).add(r[1:])
        parts = [re.escape(c) + branch(more) for c, more in heads.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(set(phrases)) if phrases else "(?!)"


def matches_category(title: Column, include: Sequence[str], exclude: Sequence[str], accessories: Sequence[str]) -> Column:
    """An include phrase, no exclude phrase, and no accessory noun before the first include phrase."""
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    place = lambda words: F.coalesce(F.regexp_instr(padded, F.lit(phrase_pattern(words))), F.lit(0))
    first, noun = place(include), place([" " + a for a in accessories])
    return (first > 0) & (place(exclude) == 0) & ((noun == 0) | (noun >= first))


def lexicon_score(text: Column, aspect: str, keywords: Sequence[str], positive: Sequence[str], negative: Sequence[str]) -> Column:
    """struct(score, evidence) of the first keyword found, in the order of the list; null without one.

    The score is 5, two more or less for each positive or negative word within 30 characters before and 40 after the hit,
    and a jitter of 0 to 1.9 less 1 from a hash of the aspect and the first 80 characters.  Evidence are the first six words
    from the hit on, or the keyword if there are none.
    """
    return let(F.lower(text), lambda low: _lexicon_score(low, aspect, keywords, positive, negative))


def lexicon_scores(text: Column, keywords: Mapping[str, Sequence[str]], positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Array of struct(aspect, s) with the `lexicon_score` of every aspect; the text is lowered once for all."""
    cell = lambda low, a, words: F.struct(F.lit(a).alias("aspect"), _lexicon_score(low, a, words, positive, negative).alias("s"))
    return let(F.lower(text), lambda low: F.array(*(cell(low, a, words) for a, words in keywords.items())))


def _lexicon_score(low: Column, aspect: str, keywords: Sequence[str], positive: Sequence[str], negative: Sequence[str]) -> Column:
    """`lexicon_score` of a lowered text: hit, place, window and digest are computed once each, and only where there is a hit."""
    found = F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in keywords))

    def told(hit: Column, at: Column, window: Column, digest: Column) -> Column:
        count = lambda words: sum((F.contains(window, F.lit(w)).cast("int") for w in words), F.lit(0))
        parts = [F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]  # 16 is 1 mod 5 and 0 mod 4
        jitter = ((sum(parts[1:], parts[0]) % 5) * 16 + (parts[3] % 4) * 5) % 20  # the number mod 20 from its remainders by 5 and by 4
        score = F.round(5.0 + (count(positive) - count(negative)) * 2.0 + jitter / 10.0 - 1.0, 1)
        words = F.split(F.trim(F.regexp_replace(F.substring(low, at + 1, F.lit(60)), r"\s+", " ")), " ")
        evidence = let(F.substring(F.array_join(F.slice(words, 1, 6), " "), 1, 60), lambda e: F.when(e == "", hit).otherwise(e))
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)).alias("score"), evidence.alias("evidence"))

    def at_place(hit: Column, at: Column) -> Column:
        start = F.greatest(at - 30, F.lit(0))
        digest = F.md5(F.concat(F.lit(aspect), F.substring(low, 1, 80)))
        return let(F.substring(low, start + 1, at + 40 - start), lambda window: let(digest, lambda d: told(hit, at, window, d)))

    return let(found, lambda hit: F.when(hit.isNotNull(), let(F.instr(low, hit) - 1, lambda at: at_place(hit, at))))


def lexicon_confidence(n_scored: Column) -> Column:
    """min(1, .4 + .1 n) of the number of aspects scored."""
    return F.round(F.least(F.lit(1.0), 0.4 + 0.1 * n_scored), 6)


def spec_coverage(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Map of aspect to 'covered' or 'missing'."""
    return F.create_map(*(x for a, words in keywords.items() for x in (F.lit(a), F.when(contains_any(F.lower(text), words), "covered").otherwise("missing"))))


def plain_quotes(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "’‘“”", "''\"\"")), r"\s+", " "))


def evidence_match(evidence: Column, text: Column) -> Column:
    """'verbatim', 'near' (every word of three letters or more occurs) or 'mismatch'."""
    phrase, whole = plain_quotes(evidence), plain_quotes(text)
    words = F.filter(F.transform(F.split(phrase, " "), lambda w: F.regexp_replace(w, "^[\"'.,!?()]+|[\"'.,!?()]+$", "")), lambda w: F.length(w) >= 3)
    near = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(whole, w))
    return F.when(F.contains(whole, phrase), "verbatim").when(near, "near").otherwise("mismatch")
