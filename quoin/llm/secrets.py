"""Secret scans: fixed patterns, and novelty under a primed compressor."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 characters or more
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|signature", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
GLUED = re.compile(r"[A-Za-z0-9]*(?:[-_./]*=+|[-_./]*)")  #: the rest of a sensitive word and what parts it from a string
NAME = re.compile(r"=*(?:[A-Za-z]+[-_.])*[A-Za-z]+=+(?=[A-Za-z0-9+/_=.-]{16})|=+")  #: of a value in the same run
NEAR = 64  #: code points of a line before a candidate that make it sensitive
AROUND = 512  #: code points on either side that prime the compressor
NOVEL = 0.6  #: marginal compressed bytes for each character of a novel string

#: Identifiers and fragments of code and configuration that are no news.
DICTIONARY = " ".join(
    "api_key apikey access_key secret_key private_key password passwd token authorization bearer basic credential signature client_id client_secret session_id user_name username email host port database localhost example.com https http www com org net import from return def class function const var let public static final void string int float bool true false null none self this new export default config settings environment production development version license copyright the and of to in is for on with as by at or an be are it that abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 BEGIN END PRIVATE KEY PUBLIC CERTIFICATE".split()
)


def marginal(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that the candidate adds where the text around it, the usual
    identifiers, and all lower-case forms of both are known already."""
    known = f"{DICTIONARY} {before.lower()} {after.lower()} {after} {before}".encode("utf-8", "replace")
    packer = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    return len(packer.compress(candidate.encode())) - len(packer.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Strings of mixed characters after a sensitive word of their line, outside known spans, that don't compress."""
    out, seen, run = [], set(), -1
    for at in (m.end() for m in SENSITIVE.finditer(text)):
        stop = text.find("\n", at)
        stop, pos = len(text) if stop < 0 else stop, at
        while m := CANDIDATE.search(text, pos, min(stop, at + NEAR + 16)):  # what starts within NEAR shows there, and is taken whole
            s = m.start()
            pos = e = run = run if s < run else CANDIDATE.match(text, s, stop).end()
            if s == at:  # not the tail of a longer word, but what comes after its separators
                s = GLUED.match(text, s, e).end()
                if s > at and text[s - 1].isalnum():
                    continue
            if n := NAME.match(text, s, e):
                s = n.end()
            whole = text[s:e]
            word = whole.strip(".=-_/")
            if e - s < 16 or (s, e) in seen or not (re.search(r"[0-9]", word) and re.search(r"[A-Za-z]", word)) or any(s < y and x < e for x, y, _ in known):
                continue
            seen.add((s, e))
            if out and s < out[-1][1]:  # another sensitive word inside a string that is found already
                continue
            if marginal(whole, text[max(0, s - AROUND) : s], text[e : e + AROUND]) >= NOVEL * len(whole):
                out.append((s, e, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(text: str | None) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    novel = novel_spans(text, base)
    n = {k: sum(1 for x in base if x[2] == k) for k in KINDS}
    return n["assign"], n["access"], n["hex"], len(novel), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel)


SCHEMA = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(t) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")])


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in each whole text: counts by kind, a digest of the pattern spans, all spans.

    Assignments, access keys and long hexadecimal runs are found by pattern, leftmost and
    without overlap in each kind. Besides, a string of 16 characters or more, letters with
    digits, that follows a sensitive word in its line, or is joined to it by one of = - _ . /, and
    lies outside those spans is measured whole: the bytes that zstandard needs for it, primed with the text around it and
    with common identifiers. NOVEL bytes a character or more make it a 'novel' span.
    Spans are kind:start:end in code points, end exclusive, by start, then by kind in the
    order of KINDS. Null and empty texts have none. Each row is scanned by itself, without
    a shuffle; repeated rows repeat, empty tables give no rows, other columns are not read.
    """
    return docs.select(F.col(id_col), F.pandas_udf(_scan, SCHEMA)(text_col).alias("s")).select(id_col, "s.*")
