"""Line-first quality rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._words import slices

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, bad_chars long"
KINDS = {"long": pa.int64(), "boolean": pa.bool_()}

MIN_WORDS = 50  #: of the base rules
MAX_LOSS = 0.5  #: of the word characters, lost with the lines that fail

NOISY_TEXT = r"[#*$%&<>]{2}|[#$%&]$|!!|\?\?"
#: phrases of page furniture in English, German, French and Spanish; A-Z are lower-cased before
BOILERPLATE_TEXT = "|".join(
    (
        r"cookie|javascript|all rights reserved|terms of (use|service)|privacy policy|subscribe (now|to)|sign (up|in) |log in |click here|copyright|©",
        r"alle rechte vorbehalten|datenschutzerkl(ä|Ä)rung|nutzungsbedingungen|jetzt abonnieren|hier klicken|melden sie sich an",
        r"tous droits r(é|É)serv(é|É)s|politique de confidentialit(é|É)|mentions l(é|É)gales|conditions d['’]utilisation|abonnez-vous|cliquez ici|connectez-vous",
        r"todos los derechos reservados|pol(í|Í)tica de privacidad|aviso legal|t(é|É)rminos de (uso|servicio)|suscr(í|Í)bete|haga clic aqu(í|Í)|inicia(r)? sesi(ó|Ó)n",
    )
)
NOISY = re.compile(NOISY_TEXT.encode())
BOILERPLATE = re.compile(BOILERPLATE_TEXT.encode())
STOPS = re.compile(rb"[.,;:!?]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc")


def bad_line(line: bytes, words: list[bytes]) -> bool:
    """Whether a line that has words fails one of the line rules.

    punctuation: a third of its words or more carry runs of symbols or of marks, or it
    has 25 words or more and no stop of any kind; navigation: three separators or more,
    making up a sixth of its words; boilerplate: up to 25 words with one of the phrases
    of page furniture.
    """
    n = len(words)
    if 3 * sum(1 for w in words if NOISY.search(w)) >= n:
        return True
    if n >= 25 and not STOPS.search(line):
        return True
    bars = words.count(b"|") + words.count(b">") + words.count(b"\xc2\xb7") + words.count(b"\xc2\xbb")
    if bars >= 3 and 6 * bars >= n:
        return True
    return n <= 25 and BOILERPLATE.search(line.lower()) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first included."""
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) == len(triples):
        return 0
    often = {t for t, c in Counter(triples).items() if c > 1}
    covered, total = 0, 0
    for i, t in enumerate(triples):
        if t in often:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def characters(words: list[bytes]) -> int:
    return len(b"".join(words).decode("utf-8", "surrogatepass"))


def judge(data: bytes) -> tuple[tuple, list[bytes] | None]:
    """(the columns of COUNTS, the lines that stay; None where all do) of a text as UTF-8."""
    words = data.split()  # bytes split at \x09-\x0D and \x20 alone
    word_chars, repeat = characters(words), repeated_words(words)
    symbols = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    seen, dup, bad, lost, left = set(), 0, 0, 0, []
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            dup += again
            seen.add(line)
            if again or bad_line(line, own):
                bad += 1
                lost += characters(own)
                continue
        left.append(line)
    n = len(words)
    failed = n < MIN_WORDS or 2 * repeat > n
    return (n, word_chars, symbols, dup, repeat, failed, not failed and lost <= MAX_LOSS * word_chars, bad, lost), left if bad else None


def texts(part: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in part[column].cast(pa.binary()).to_pylist()]


def report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in COUNTS.split(", ")))
    for batch in batches:
        for part in slices(batch, "text"):
            columns = zip(*(judge(t)[0] for t in texts(part, "text")))
            yield pa.RecordBatch.from_arrays([part["id"], *(pa.array(c, KINDS[k]) for c, k in zip(columns, kinds))], ["id", *names])


def cleaned_rows(text_col: str, chars_col: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = [judge(t) for t in texts(part, text_col)]
                keep = [i for i, (counts, _) in enumerate(found) if counts[6]]
                if not keep:
                    continue
                part = part.take(pa.array(keep, pa.int32()))
                edits = [found[i][1] for i in keep]
                if any(left is not None for left in edits):
                    old = part[text_col].to_pylist()
                    new = [t if left is None else b"\n".join(left).decode("utf-8", "surrogatepass") for t, left in zip(old, edits)]
                    at = part.schema.get_field_index(text_col)
                    part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                    if chars_col:
                        at = part.schema.get_field_index(chars_col)
                        was = part[chars_col].to_pylist()
                        lengths = [c if left is None else len(t) for c, t, left in zip(was, new, edits)]
                        part = part.set_column(at, part.schema.field(at), pa.array(lengths, part.schema.field(at).type))
                yield part

    return rows


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the base counts, the verdict, and what its bad lines take.

    Lines come first: each line with words is judged by the punctuation, navigation and
    boilerplate rules (bad_line), and a line equal to an earlier one of its text fails
    too. A document that loses more than MAX_LOSS of its word characters with the lines
    that fail is rejected, as is one that fails the base rules (fewer than MIN_WORDS
    words, or more than half of them in repeated 3-word windows). Null and empty texts
    have no words and are rejected. Rows are judged one by one without a shuffle, whatever
    the length of a text, so ties, repeated ids and empty tables need no care, and other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(report_rows, f"id {rows.schema['id'].dataType.simpleString()}, {COUNTS}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The documents that pass, with their own columns, their texts without the lines that
    fail. Lines without words stay as they are, so a text that loses nothing is unchanged.
    chars_col, if named, holds the code points of a text and is set anew where lines go.
    All columns are handed through; null and empty texts are rejected; repeated rows are
    judged each, and all that pass stay; an empty table stays one."""
    return docs.mapInArrow(cleaned_rows(text_col, chars_col), docs.schema)
