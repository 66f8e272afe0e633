"""Secret scans by one combined automaton.

All rules, reversed, become one minimal automaton that searches. It reads a batch of texts backwards in one pass over their bytes,
for all rules together, thousands of lanes at a time; after the byte at p its accept bits name the rules of which a match begins at p.
From those starts, leftmost first and not inside an earlier match, each rule's own anchored automaton finds the longest end.
Rules are such that the longest match is the one a backtracking engine finds (their parts are told apart by their first byte).

Matches that are too short are found and dropped, as the base kinds ask (assign: a value of under 12 characters). Only hex has its
bound in the rule, which is the same there: a match is a whole run, and the automaton then names the starts of long runs alone.
Offsets are code points.

Defined cases: null text is empty; NUL bytes belong to no rule, so they may part texts; repeated rows get equal results; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .automaton import Automaton, Syntax, compile_rules, lanes, longest, reverse
from .common import table

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, whether letters match in either case, least length. Base kinds first; formats of further tokens are fixed values.
RULES = (
    ("assign", ASSIGN, True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 18),
    ("hex", r"[0-9a-f]{16,}", False, 16),
    ("github", r"gh[oprsu]_[A-Za-z0-9]+", False, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40),
    ("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", False, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
)
BASE = ("assign", "access", "hex")
VALUE = 12
#: Bytes that one pass takes together.
BATCH_BYTES = 16 << 20


class Scanner:
    def __init__(self, rules=RULES) -> None:
        trees = [Syntax(p, any_case=c).parse() for _, p, c, _ in rules]
        self.kinds, self.least = [r[0] for r in rules], [r[3] for r in rules]
        self.back = compile_rules([reverse(t) for t in trees], search=True)
        self.ahead: list[Automaton] = [compile_rules([t], search=False) for t in trees]
        self.assign = re.compile(ASSIGN.encode("ascii"), re.IGNORECASE)

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, kind, end), in code points, sorted."""
        data = b"\0".join(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        bits = lanes(self.back, np.frombuffer(data, np.uint8)[::-1])[::-1]
        hits = np.flatnonzero(bits)
        if not hits.size:
            return out
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(ends, hits, "right")
        for k in np.unique(owner):
            text, first = texts[k], int(ends[k]) - len(texts[k]) - 1
            own = hits[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
            found = []
            for rule, auto in enumerate(self.ahead):
                done = 0
                for s in own[bits[own] >> rule & 1 > 0] - first:
                    if s < done:
                        continue
                    done = longest(auto, text, s)
                    if done - s >= self.least[rule] and (self.kinds[rule] != "assign" or len(self.assign.fullmatch(text, int(s), done)[2]) >= VALUE):
                        found.append((int(s), rule, done))
            if found:
                points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
                out[k] = sorted((int(points[s]) - 1, rule, int(points[e - 1])) for s, rule, e in found)
        return out


SCHEMA = "doc_id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans as kind:start:end."""
    scanner, kinds = Scanner(rules), [r[0] for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(1).cast(pa.large_binary()).to_pylist()
            texts, k = [x or b"" for x in body], 0
            while k < len(texts):
                last, size = k, 0
                while last < len(texts) and (size == 0 or size + len(texts[last]) <= BATCH_BYTES):
                    size += len(texts[last]) + 1
                    last += 1
                spans = scanner.spans(texts[k:last])
                said = [[(kinds[r], f"{kinds[r]}:{s}:{e}") for s, r, e in x] for x in spans]
                counts = [[sum(kind == b for kind, _ in x) for x in said] for b in BASE]
                digest = [hashlib.sha256(",".join(t for kind, t in x if kind in BASE).encode()).hexdigest() for x in said]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, last - k), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([",".join(t for _, t in x) for x in said], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
                k = last

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
