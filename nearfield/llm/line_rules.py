"""Quality rules, line first.

Every line of a document is judged by rules for punctuation, navigation and
boilerplate; failing lines are removed, and a document that loses more than
``max_loss`` of its word characters is rejected.  Beside the verdict each row
carries plain counts over the whole text.

One pass over the rows, no shuffle: a text is handled inside the task that
reads it.

Defined results: a null or empty text has no words, so every count is 0 and
``base_failed`` is true; a row is judged by itself, so repeated rows give
repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import require

MAX_LOSS = 0.5

# The characters that count as symbols, and the white space that parts words.
SYMBOLS = "#*$%&|<>"
WORD_GAPS = " \t\n\x0b\x0c\r"

#: Phrases that mark a line as boilerplate of a site rather than text.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "copyright",
    "enable javascript",
    "licensed under",
    "log in",
    "privacy policy",
    "released under the",
    "sign up",
    "subscribe to",
    "terms of service",
    "terms of use",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_MARKS = re.compile(r"[#*$%&<>{}\\^~=@]|[!?]{2,}")
_SEPARATORS = re.compile(r"[|»«›‹•·→]|(?<=\s)[>/](?=\s)")
_SENTENCE = re.compile(r"[.!?…:;,。]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, removed_chars long"
)


def line_fault(line: str) -> str | None:
    """The rule a line fails, or None.  A line without a word fails none."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if len(_SEPARATORS.findall(line)) >= max(2, 0.2 * n):
        return "navigation"
    if len(_MARKS.findall(line)) >= max(3, 0.3 * n):
        return "punctuation"
    if n <= 3 and not _SENTENCE.search(line) and line[:1].isupper() and not any(c.isdigit() for c in line):
        return "navigation"
    if n <= 30 and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 8 and len(set(words)) <= 0.25 * n:
        return "boilerplate"
    return None


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_GAPS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WORD_GAPS)]
    repeated = 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(grams)
    if len(found) < len(grams):
        end = 0
        for i, gram in enumerate(grams):
            if found[gram] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def clean_text(text: str) -> tuple[str, int, int, int]:
    """The text without failing lines; lines with a word, lines removed, word characters removed."""
    kept, n, gone, lost = [], 0, 0, 0
    for line in text.split("\n"):
        n += bool(line.strip(WORD_GAPS))
        if line_fault(line):
            gone += 1
            lost += len(line) - sum(map(line.count, WORD_GAPS))
        else:
            kept.append(line)
    return "\n".join(kept), n, gone, lost


def judge(text: str, max_loss: float = MAX_LOSS) -> tuple[tuple, str]:
    """The result columns after doc_id, and the cleaned text."""
    n, chars, symbols, dup, repeated = text_counts(text)
    cleaned, n_lines, gone, lost = clean_text(text)
    failed = n < 50 or 100 * repeated > 50 * n
    kept = not failed and lost <= max_loss * chars
    return (n, chars, symbols, dup, repeated, failed, kept, n_lines, gone, lost), cleaned


def line_rules(docs: DataFrame, max_loss: float = MAX_LOSS, with_text: bool = False) -> DataFrame:
    """Judge every document of ``docs`` (doc_id, text); ``with_text`` adds ``clean_text``."""
    schema = SCHEMA + (", clean_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [judge(t or "", max_loss) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), *map(pa.array, zip(*(r[0] for r in rows), strict=True))]
                if with_text:
                    columns.append(pa.array([r[1] for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return require(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, schema)
