"""Operator 12: URL filter by a bit-parallel wildcard automaton.

Glob rules are packed one after the other into a row of 64-bit words, one bit for
each number of symbols matched.  For each byte of a canonical URL all bits of all
rules move at once (Shift-And):

    state = ((state << 1) & step[byte]) | (state & stay[byte])

``step`` holds the symbols, ``stay`` the loops of the wildcards; a shift carries
over word borders, and a rule's first bit is never entered again, so that rules
are anchored at both ends.  Rules lie in order of precedence: the lowest final bit
names the winner.  A batch of URLs goes through in step, longest first; the last
few very long ones go on alone, with one wide integer each.

Globs match ``host + path``: ``*`` any run of bytes without ``/``, ``**`` any run,
``?`` one character, all else itself.  A host rule becomes two globs, for the host and
for its subdomains.  Host rules come before the filter's own globs, the longest first;
a URL that nothing fits is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end.

Defined cases: a null URL and one without ``://`` have empty host and path, which
the empty glob of ``FILTER`` blocks; a URL of any length is read whole; repeated
rows and rows with a null page_id are judged one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.session import ship_package

U = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALONE = 8  # so few URLs left in step go on one by one


class Glob(NamedTuple):
    pattern: str
    verdict: str
    rule: str | None


# The rules of the contract (host, path).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
# The filter's own globs: no address, mirrors for small screens, files without prose, forms and listings.
FILTER = ["", "m.*/**", "amp.*/**", "ads.*/**", "*.ads.*/**",
          "**.jpg", "**.jpeg", "**.png", "**.gif", "**.webp", "**.svg", "**.ico", "**.css", "**.js", "**.woff?",
          "**.mp?", "**.zip", "**.gz", "**.exe",
          "**/login*", "**/signup*", "**/cart/**", "**/search/**", "**/tag/*/page/*"]


def globs_of(rules: list[tuple[str, str]], own: list[str]) -> list[Glob]:
    """In order of precedence."""
    out = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        if any(c in rule for c in "*?"):
            raise ValueError(f"a host rule holds no wildcards: {rule!r}")
        out += [Glob(f"{rule}**", verdict, rule), Glob(f"*.{rule}**", verdict, rule)]
    return out + [Glob(p, "block", None) for p in own]


class Automaton:
    """The masks of some globs."""

    def __init__(self, patterns: list[str]):
        bits, self.first, self.final, owner = 0, 0, 0, {}
        move = [0] * 256
        stay = [0] * 256
        for i, p in enumerate(patterns):
            at = bits
            self.first |= 1 << at
            raw = p.encode()
            j = 0
            while j < len(raw):
                c = raw[j]
                if c == 42:
                    deep = raw[j: j + 2] == b"**"
                    for b in range(256):
                        if deep or b != 47:
                            stay[b] |= 1 << at
                    j += 1 + deep
                    continue
                at += 1
                if c == 63:
                    for b in range(256):
                        if 0x80 <= b < 0xC0:
                            stay[b] |= 1 << at
                        else:
                            move[b] |= 1 << at
                else:
                    move[c] |= 1 << at
                j += 1
            self.final |= 1 << at
            owner[at] = i
            bits = at + 1
        self.words = max(1, -(-bits // 64))
        self.move, self.stay = move, stay
        self.owner = np.full(self.words * 64, -1, np.int64)
        for at, i in owner.items():
            self.owner[at] = i
        self.move_w = np.array([self._split(x) for x in move])
        self.stay_w = np.array([self._split(x) for x in stay])
        self.first_w, self.final_w = self._split(self.first), self._split(self.final)

    def _split(self, x: int) -> np.ndarray:
        return np.frombuffer(x.to_bytes(self.words * 8, "little"), "<u8").astype(U)

    def _alone(self, state: np.ndarray, rest: np.ndarray) -> np.ndarray:
        x = int.from_bytes(state.astype("<u8").tobytes(), "little")
        move, stay = self.move, self.stay
        for c in rest.tobytes():
            x = ((x << 1) & move[c]) | (x & stay[c])
            if not x:
                break
        return self._split(x)

    def winners(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Per text buf[off[i]:off[i+1]]: the first glob that fits, or -1."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        start, length = off[:-1][order], size[order]
        state = np.tile(self.first_w, (len(size), 1))
        j, longest = 0, int(length[0]) if len(length) else 0
        while j < longest:
            live = int(np.searchsorted(-length, -j, side="left"))
            if live < ALONE:
                for i in range(live):
                    state[i] = self._alone(state[i], buf[start[i] + j: start[i] + length[i]])
                break
            c = buf[start[:live] + j]
            now = state[:live]
            moved = now << U(1)
            moved[:, 1:] |= now[:, :-1] >> U(63)
            state[:live] = (moved & self.move_w[c]) | (now & self.stay_w[c])
            j += 1
        out = np.full(len(size), -1, np.int64)
        for w in reversed(range(self.words)):
            hit = state[:, w] & self.final_w[w]
            some = np.flatnonzero(hit)
            low = hit[some] & (~hit[some] + U(1))
            out[order[some]] = self.owner[w * 64 + np.log2(low.astype(np.float64)).astype(np.int64)]
        return out


def _judge(globs: list[Glob]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([g.pattern for g in globs])
        rules = pa.array([g.rule for g in globs], pa.string())
        verdicts = pa.array([g.verdict for g in globs], pa.string())
        names = pa.array([g.pattern for g in globs], pa.string())
        for b in batches:
            won = [machine.winners(s.buf, s.off) for s in T.slices(b.column("address"))]
            won = np.concatenate(won) if won else np.zeros(0, np.int64)
            at = pa.array(won, mask=won < 0)
            yield pa.record_batch([b.column("page_id"), b.column("host"), b.column("path"), rules.take(at),
                                   verdicts.take(at).fill_null("allow"), names.take(at)],
                                  ["page_id", "host", "path", "rule", "verdict", "glob"])
    return run


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path, address (host + path) of pages (page_id, url, ...)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    mark = F.instr(url, "://")
    after = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), after.alias("after"))
            .select("page_id", F.translate(F.regexp_extract("after", "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
                    F.regexp_extract("after", "^[^/?#]*([^?#]*)", 1).alias("path"))
            .select("*", F.concat("host", "path").alias("address")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, own: list[str] = FILTER) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict, glob (that decided;
    null where none fits).  One pass over the rows, no shuffle."""
    ship_package(pages.sparkSession)
    return split_url(pages).mapInArrow(
        _judge(globs_of(rules, own)), "page_id long, host string, path string, rule string, verdict string, glob string")
