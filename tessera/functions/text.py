"""Text functions: tidying, sentence and word spans, token categories, sections. One pass over each text, without a shuffle."""

from __future__ import annotations

import collections
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Residue of removed markup and what it becomes, in this order.
TIDY = [(r"[ \t\r\n]+", " "), (r"\([ ,;:–—-]*\)", ""), (r"\[ *\]", ""), (r"\( *[,;:] *", "("), (r" *[,;:] *\)", ")"), (r" +([.,;:!?…)\]»”])", "$1"), (r"([,;:])( *[,;:])+", "$1"), (r" +", " ")]
# Abbreviations that don't end a sentence, lower case without the last full stop.
ABBREVIATIONS = (
    "sr sra srs dr dra drs prof profa profs sto sta st jr av séc sec p.ex ex etc a.c d.c n.º nº n pág págs p pp vol vols cap caps ed eds fig figs cf aprox máx mín "
    "s.a ltda hab sq gen cel ten sgt mr mrs ms vs op cit ibid apud art arts inc col cols org trad i.e e.g c ca"
).split()

BREAK = "\u001e"
CLOSING = "\"'»”’)\\]"
# A possible end before white space and a capital, digit or opening mark; an end after an abbreviation or an initial, which is none.
POSSIBLE_END = f"([.!?…]+[{CLOSING}]*)(\\s+[\\p{{Lu}}\\p{{Nd}}\"'«“(—–-])"
NO_END = f"((?:^|\\s)[(\"'«“]*(?:\\p{{Lu}}|(?i:{'|'.join(re.escape(x) for x in ABBREVIATIONS)}))\\.[.!?…]*[{CLOSING}]*){BREAK}"
_WORD = re.compile(r"\w+")
# Scripts that count as one other script.
SCRIPTS = ("Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Thai", "Armenian", "Georgian", "Bengali", "Tamil")


def tidy(column: Column) -> Column:
    for pattern, new in TIDY:
        column = F.regexp_replace(column, pattern, new)
    return F.trim(column)


def sentences(column: Column) -> Column:
    """The sentences of a text in turn, each with the white space before it; joined they are the text (a BREAK in it counts as a space)."""
    marked = F.regexp_replace(F.translate(column, BREAK, " "), POSSIBLE_END, f"$1{BREAK}$2")
    return F.split(F.regexp_replace(marked, NO_END, "$1"), BREAK)


def sentence_spans(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, sentence, piece, start, end (half open, without white space around) of each sentence of a text column; texts are split, not joined, so one window adds up lengths."""
    pieces = rows.select(*keys, F.posexplode(sentences(F.col(text))).alias("sentence", "piece")).withColumn("__n", F.length("piece"))
    at = F.sum("__n").over(Window.partitionBy(*keys).orderBy("sentence").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    inner = F.regexp_replace("piece", r"^\s+", "")
    start = at + F.col("__n") - F.length(inner)
    spans = pieces.withColumn("start", start).withColumn("end", F.col("start") + F.length(F.regexp_replace(inner, r"\s+$", "")))
    return spans.where("end > start").drop("__n")


def word_spans(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text or "")]


def token_kinds(text: str, offsets: Iterable[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
    """(category, word, place in the word, tokens of the word) of each token; -1, -1, 0 outside words. A token goes to the word that it shares most alphanumeric characters with, the earlier one on a tie."""
    words, offsets = word_spans(text), list(offsets)
    owner = [-1] * len(offsets)
    kind = []
    at = 0  # the first word that ends after the last token's start; tokens rise
    for i, (a, b) in enumerate(offsets):
        piece = text[a:b]
        while at < len(words) and words[at][1] <= a:
            at += 1
        shares = []
        for w in range(at, len(words)):
            if words[w][0] >= b:
                break
            shares.append((sum(map(str.isalnum, text[max(a, words[w][0]) : min(b, words[w][1])])), -w))
        best, place = max(shares, default=(0, 0))
        if best:
            owner[i] = -place
            kind.append("number" if all(c.isdigit() for c in piece if c.isalnum()) else "word")
        else:
            kind.append("punctuation" if piece.strip() else "whitespace")
    total: dict[int, int] = {}
    place = []
    for w in owner:
        place.append(total.get(w, 0) if w >= 0 else -1)
        total[w] = total.get(w, 0) + 1
    out = []
    for k, w, p in zip(kind, owner, place, strict=True):
        n = total[w] if w >= 0 else 0
        out.append((k if k != "word" else "whole_word" if n == 1 else "continuation" if p else "word_start", w, p, n))
    return out


def token_rows(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(category, continues, n): how many tokens of texts(text) are of each category and have more tokens of their word after them, by a tokenizer file.

    The counts are added up in each task, so a row for each pair leaves it.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, total = Tokenizer.from_file(tokenizer_path), collections.Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                some = [t for t in batch.column(0).slice(lo, 100).to_pylist() if t]
                for text, e in zip(some, tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                    total.update((kind, place + 1 < size) for kind, _, place, size in token_kinds(text, e.offsets))
        yield pa.RecordBatch.from_pydict({"category": pa.array([k[0] for k in total], pa.string()), "continues": pa.array([k[1] for k in total], pa.bool_()), "n": pa.array(list(total.values()), pa.int64())})

    return texts.select("text").mapInArrow(run, "category string, continues boolean, n long")


def script_class(column: Column) -> Column:
    """Writing system of a string: byte_fragment, whitespace, digits, punctuation, latin, cjk, other_script (one of SCRIPTS), mixed, in that order."""
    x = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    kind = F.when(F.contains(column, F.lit("\ufffd")), "byte_fragment").when(x == "", "whitespace").when(x.rlike(r"^\p{Nd}+$"), "digits").when(~x.rlike(r"[\p{L}\p{N}]"), "punctuation")
    kind = kind.when(x.rlike(r"^\p{IsLatin}+$"), "latin").when(x.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+$"), "cjk")
    return kind.when(x.rlike("^(" + "|".join(f"\\p{{Is{n}}}+" for n in SCRIPTS) + ")$"), "other_script").otherwise("mixed")


def windowed(text: Column, start: Column, end: Column, chars: int) -> tuple[Column, Column]:
    """The text before start and after end, `chars` characters at most, cut at a space, with … where something is left out."""
    before = F.substring(text, F.greatest(start - chars + 1, F.lit(1)), F.least(start, F.lit(chars)))
    after = F.substring(text, end + 1, F.lit(chars))
    left = F.when(start > chars, F.concat(F.lit("…"), F.regexp_replace(before, r"^\S*\s", ""))).otherwise(before)
    right = F.when(F.length(text) - end > chars, F.concat(F.regexp_replace(after, r"\s\S*\z", ""), F.lit("…"))).otherwise(after)
    return left, right


def context(words: Column, place: Column, width: int = 8) -> Column:
    """The words around words[place] (from 0), itself between « and »."""
    low = F.greatest(place - width, F.lit(0))
    left = F.slice(words, low + 1, place - low)
    right = F.slice(words, place + 2, F.lit(width))
    return F.array_join(F.concat(left, F.array(F.concat(F.lit("«"), F.get(words, place), F.lit("»"))), right), " ")


HEADING = r"^(={2,6})\s*(.+?)\s*\1\s*$"


def cut_sections(rows: DataFrame, key: str, text: str, titles: Iterable[str]) -> DataFrame:
    """(key, text) without the sections of these titles and their subsections; headings are lines of 2 to 6 equals signs around a title.

    Lines are rows: a heading of a title opens a cut at its level, the next heading of that level or above closes it. Whether a line is cut
    depends on the latest heading at each level only, so six running windows replace a scan.
    """
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("__at", "__line"))
    level = F.length(F.regexp_extract("__line", HEADING, 1))
    wanted = F.lower(F.regexp_extract("__line", HEADING, 2)).isin([t.strip().lower() for t in titles])
    lines = lines.withColumn("__level", level).withColumn("__cut", (F.col("__level") > 0) & wanted)
    w = Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.lit(False)
    for n in range(2, 7):  # the latest heading of level n or above decides whether a cut at level n is open
        last = F.last(F.when(F.col("__level").between(1, n), (F.col("__level") == n) & F.col("__cut")), ignorenulls=True).over(w)
        inside = inside | F.coalesce(last, F.lit(False))
    kept = lines.withColumn("__inside", inside).groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("__inside"), F.struct("__at", "__line")))).alias("__all"))
    return kept.select(key, F.array_join(F.transform("__all", lambda x: x["__line"]), "\n").alias(text))


def template_names(column: Column) -> Column:
    """Lower-case names of the templates that a text opens, in turn, underscores as spaces."""
    found = F.regexp_extract_all(column, F.lit(r"\{\{([^{}|]+)"), F.lit(1))
    return F.transform(found, lambda x: F.translate(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), "_", " "))


def band_label(value: Column, bands: list[tuple[int, int]], open_top: bool = False) -> Column:
    """'low-high', or 'low' where they are equal, of the band that holds a value; the last is 'low+' with open_top. Bands must join from 1 on; a value outside all is an error."""
    if not bands or bands[0][0] != 1 or any(hi < lo for lo, hi in bands) or any(b[0] != a[1] + 1 for a, b in zip(bands[:-1], bands[1:], strict=True)):
        raise ValueError(f"bands must be joined intervals from 1, not {bands}")
    out = None
    for i, (lo, hi) in enumerate(bands):
        top = open_top and i == len(bands) - 1
        inside = (value >= lo) if top else value.between(lo, hi)
        name = f"{lo}+" if top else f"{lo}" if lo == hi else f"{lo}-{hi}"
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("outside the bands: "), value.cast("string"))))
