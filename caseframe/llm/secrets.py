"""Secret scans: base patterns, and a character network over every other candidate."""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm import secret_net

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of them is in every text with an assignment; the check is quick.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Candidates are runs of so many of these characters ...
LEAST = 6
RUN = re.compile(r"[A-Za-z0-9+/_.~!@$%%^&*-]{%d,}={0,2}" % LEAST)
#: ... that aren't words, words joined by a mark, or numbers; letters alone count as a word only up to this length.
LONG_WORD = 20
PROSE = re.compile(r"(?:[A-Z]{0,2}[a-z]+|[A-Z]+)(?:[-_./&@][A-Za-z]?[a-z]+)*|[0-9][0-9.,/%-]*")
#: After one of these words and a mark any run is a candidate. One of CUES is in every text with such a word.
CUE = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|passwort|pin|key|secret|token|auth\w*|bearer|basic|credentials?|signature|session)["']?(?:\s*[:=]\s*|\s+(?:is|was)\s+)["']?""", re.I)
CUES = ("pass", "pwd", "pin", "key", "secret", "token", "auth", "bearer", "basic", "credential", "signature", "session")
#: Marks at the ends of a run are no part of it, nor is a repeated one.
MARKS, ENDS = string.punctuation + "«»“”„‘’…–—", ".-_/!&*,"
REPEATED = re.compile(r"([^A-Za-z0-9=])\1+$|^([^A-Za-z0-9])\2+")
REPLACEMENT = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, in order of start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _trimmed(run: str, at: int) -> tuple[int, int]:
    """Place of a run that begins at ``at``, without marks at its ends."""
    while (left := REPEATED.sub("", run.rstrip(ENDS))) and left != run:
        lead = run.find(left)
        run, at = left, at + lead
    start = len(run) - len(run.lstrip(ENDS))
    return at + start, at + len(run)


def candidates(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Places of the runs of the whole text that are no prose, or follow a cue; those within known spans are left out."""
    places, at = set(), 0
    for word in text.split():
        if len(word) < LEAST:
            continue
        core = word.strip(MARKS)
        if core.isalpha() and len(core) < LONG_WORD and (core[2:].islower() or core.isupper()):
            continue
        at = text.index(word, at)
        for m in RUN.finditer(word):
            start, end = _trimmed(m[0], at + m.start())
            run = text[start:end]
            if not PROSE.fullmatch(run) or run.isalpha() and len(run) >= LONG_WORD:
                places.add((start, end))
        at += len(word)
    low = text.lower()
    if any(c in low for c in CUES):
        for m in CUE.finditer(text):
            if run := RUN.match(text, m.end()):
                places.add(_trimmed(run[0], run.start()))
    starts, ends = [], []  # what the known spans cover, in order
    for s, e, _ in known:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    covered = lambda s, e: (k := bisect_right(starts, s) - 1) >= 0 and e <= ends[k]
    return [p for p in sorted(places) if p[1] - p[0] >= LEAST and not covered(*p)]


def scan_texts(texts: list[str], net: secret_net.Net) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: the base ones and the candidates that the network takes for secrets."""
    found = [base_spans(t) for t in texts]
    owners, ids, lengths, shapes = [], [], [], []
    for i, text in enumerate(texts):
        for place in candidates(text, found[i]):
            kind = secret_net.shape(text[place[0] : place[1]])
            for row, n in secret_net.window(text, *place):
                owners.append((i, place))
                ids.append(row)
                lengths.append(n)
                shapes.append(kind)
    if ids:
        hit = net.probability(np.stack(ids), np.array(lengths)) >= net.thresholds[shapes]
        for i, place in dict.fromkeys(owner for owner, h in zip(owners, hit.tolist(), strict=True) if h):
            found[i].append((*place, "net"))
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))) for spans in found]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_net long, base_sha256 string, spans string"


def scan(docs: DataFrame, net: secret_net.Net | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_net, base_sha256, spans of each row of ``docs`` (doc_id, text).

    Whole texts are searched; a null or empty text has no spans and the digest
    of the empty string. Repeated rows are scanned each, a null doc_id stays
    null, other columns are ignored, and an empty table gives an empty result.
    """
    net = net or secret_net.trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_texts([t or "" for t in batch.column(1).to_pylist()], net)
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in found], pa.int64()) for kind in KINDS]
            digests = [hashlib.sha256(joined([s for s in spans if s[2] != "net"]).encode()).hexdigest() for spans in found]
            columns = [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(list(map(joined, found)), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch of touching spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start > at or not out:
            out += [text[at:start], REPLACEMENT]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: secret_net.Net | None = None) -> DataFrame:
    """``docs`` with the secrets of its texts replaced; n_chars follows where it is there and a text changes.

    Null texts stay null, texts without secrets and all other columns stay as
    they are, whatever their names; repeated rows are redacted alike; an empty
    table gives an empty result.
    """
    net = net or secret_net.trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = batch.column(at).to_pylist()
            found = scan_texts([t or "" for t in texts], net)
            changed = [redact_text(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(changed, batch.schema.field(at).type)
            if "n_chars" in batch.schema.names:
                k = batch.schema.names.index("n_chars")
                columns[k] = pa.array([len(t) if s else n for n, t, s in zip(columns[k].to_pylist(), changed, found, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
