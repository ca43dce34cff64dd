"""URL filters: all glob rules run at once as one multiword Shift-And automaton.

A rule is a host part and a path part in which ``*`` stands for any run of bytes. Rules become one long
row of state bits: for each rule a start bit and a bit for every literal byte. A byte of the URL moves
all states with one shift, one AND with the byte's mask and one OR that keeps the states standing
before a ``*``. Whole batches of URLs are moved together; the words of a URL's state pass their top
bit on to the next word.

Defined results: a null URL or one without ``://`` has an empty host and path, so only rules that fit
an empty host can judge it; without any rule a URL is allowed. Repeated rows are judged each for
itself; other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between host and path in the canonical URL; no UTF-8 text holds this byte.
BORDER = b"\xff"
#: Fewer URLs than this that are still unread are moved one by one as Python integers.
FEW = 8


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block'; host fits itself and all subdomains; path is a prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[bytes]:
        host, path = _escape(self.host), _escape(self.path)
        return [host + BORDER + path + b"*", b"*." + host + BORDER + path + b"*"]


@dataclass(frozen=True)
class Glob:
    """verdict 'allow' or 'block' for URLs whose host and whole path with query fit the globs."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[bytes]:
        return [self.host.encode() + BORDER + self.path.encode()]


#: A literal star in a host or path rule.
STAR = b"\xfe"


def _escape(text: str) -> bytes:
    return text.encode().replace(b"*", STAR)


class Automaton:
    """Bit-parallel matcher of many globs that must fit the whole input."""

    def __init__(self, globs: list[bytes]):
        bits, literal, stay, final, start = 0, [], [], [], []
        for g in globs:
            start.append(bits)
            at = bits
            for byte in g:
                if byte == ord("*"):
                    stay.append(at)
                else:
                    at += 1
                    literal.append((at, ord("*") if byte == STAR[0] else byte))
            final.append(at)
            bits = at + 1
        self.words = max(1, -(-bits // 64))
        self.final = final
        self.mask_int = [0] * 256
        for bit, byte in literal:
            self.mask_int[byte] |= 1 << bit
        self.stay_int = sum(1 << b for b in set(stay))
        self.start_int = sum(1 << b for b in start)
        self.mask = np.stack([self._split(m) for m in self.mask_int])
        self.stay, self.start = self._split(self.stay_int), self._split(self.start_int)

    def _split(self, value: int) -> np.ndarray:
        return np.frombuffer(value.to_bytes(8 * self.words, "little"), dtype="<u8").astype(np.uint64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (texts, globs)."""
        n = len(texts)
        if not n:
            return np.zeros((0, len(self.final)), dtype=bool)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        sorted_lengths = lengths[order]
        data = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        state = np.broadcast_to(self.start, (n, self.words)).copy()
        longest, one, top = int(sorted_lengths[0]), np.uint64(1), np.uint64(63)
        step = 0
        while step < longest:
            active = int(np.searchsorted(-sorted_lengths, -step, side="left"))
            if active < FEW:
                break
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.mask[data[offsets[:active] + step]]
            now &= self.stay
            now |= moved
            step += 1
        for i in range(int(np.searchsorted(-sorted_lengths, -step, side="left"))):
            state[i] = self._finish(state[i], texts[order[i]], step)
        out = np.empty((n, len(self.final)), dtype=bool)
        for j, bit in enumerate(self.final):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out

    def _finish(self, state: np.ndarray, text: bytes, step: int) -> np.ndarray:
        now, masks, stay = int.from_bytes(state.astype("<u8").tobytes(), "little"), self.mask_int, self.stay_int
        for byte in text[step:]:
            now = (now << 1) & masks[byte] | now & stay
        return self._split(now & ((1 << 64 * self.words) - 1))


def judge_urls(df: DataFrame, rules: list[Rule], globs: list[Glob], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and pattern (the glob that decided, if no rule did).

    The longest fitting rule decides, then the longest fitting glob; at equal length 'block' wins, then
    the smaller text. What nothing fits is allowed.
    """
    rank = lambda r: (len(r.text), r.verdict == "block", [-ord(c) for c in r.text])
    ranked_rules, ranked_globs = sorted(rules, key=rank), sorted(globs, key=rank)
    compiled = [(kind, i, g) for kind, group in ((0, ranked_rules), (1, ranked_globs)) for i, r in enumerate(group) for g in r.globs()]
    automaton = Automaton([g for _, _, g in compiled])

    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    found = F.locate("://", text)
    rest = F.when(found > 0, F.substr(text, found + 3)).otherwise(F.lit(""))
    parts = df.select(F.col(f"`{key}`").alias(key), rest.alias("rest")).select(
        key,
        F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("rest", r"^[^?#]*(\?[^#]*)?", 1).alias("query"),
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, query = (batch.column(c).to_pylist() for c in ("host", "path", "query"))
            hits = automaton.run([h.encode() + BORDER + p.encode() + q.encode() for h, p, q in zip(host, path, query, strict=True)])
            best = np.full((2, batch.num_rows), -1, dtype=np.int64)
            for j, (kind, i, _) in enumerate(compiled):
                best[kind][hits[:, j]] = np.maximum(best[kind][hits[:, j]], i)
            rule = [ranked_rules[i] if i >= 0 else None for i in best[0]]
            glob = [ranked_globs[i] if i >= 0 and r is None else None for i, r in zip(best[1], rule, strict=True)]
            yield pa.record_batch({
                key: batch.column(key), "host": batch.column("host"), "path": batch.column("path"),
                "rule": pa.array([r and r.text for r in rule], pa.string()),
                "verdict": pa.array([(r or g).verdict if r or g else "allow" for r, g in zip(rule, glob, strict=True)], pa.string()),
                "pattern": pa.array([g and g.text for g in glob], pa.string()),
            })

    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(match, f"`{key}` {kind}, host string, path string, rule string, verdict string, pattern string")
