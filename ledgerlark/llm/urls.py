"""URL filters by a bit-parallel wildcard automaton.

Each glob rule becomes a row of states; the rows are packed one after another
into 64-bit words.  One Shift-And step moves every rule over the next byte of
every URL of a batch: ``D = ((D << 1) & B[c]) | (D & L[c])``, where B has the
states that byte c may enter and L those in which a wildcard may stay on c.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    """``*``: any run without ``/``; ``**``: any run; ``?``: one character, not ``/``.  Over ``.host/path``."""

    glob: str
    verdict: str = "block"
    ignore_case: bool = True


#: Globs that judge what no host rule fits.
DEFAULT_GLOBS = (
    GlobRule("**casino**"),
    GlobRule("**cheap-pills**"),
    GlobRule("**viagra**"),
    GlobRule("**poker**"),
    GlobRule("**payday-loan**"),
    GlobRule("**adult-video**"),
    GlobRule("**xxx**"),
)


class Automaton:
    """Multiword Shift-And masks of glob patterns over UTF-8 bytes."""

    def __init__(self, globs: Sequence[tuple[str, bool]]):
        enter: list[np.ndarray] = []
        stay: list[np.ndarray] = []
        self.first, self.last = [], []
        anything, no_slash, inner = np.ones(256, bool), np.ones(256, bool), np.zeros(256, bool)
        no_slash[ord("/")] = False
        inner[0x80:0xC0] = True
        for glob, ignore_case in globs:
            self.first.append(len(enter))
            enter.append(np.zeros(256, bool))
            stay.append(np.zeros(256, bool))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    stay[-1] |= anything
                    i += 2
                    continue
                if raw[i] == ord("*"):
                    stay[-1] |= no_slash
                else:
                    takes, holds = np.zeros(256, bool), np.zeros(256, bool)
                    if raw[i] == ord("?"):
                        takes, holds = no_slash & ~inner, inner.copy()
                    else:
                        takes[raw[i]] = True
                        if ignore_case:
                            takes[list(bytes([raw[i]]).lower() + bytes([raw[i]]).upper())] = True
                    enter.append(takes)
                    stay.append(holds)
                i += 1
            self.last.append(len(enter) - 1)
        self.words = max(1, -(-len(enter) // 64))
        self.enter, self.stay = self._packed(enter), self._packed(stay)
        self.start = np.zeros(self.words, np.uint64)
        for s in self.first:
            self.start[s // 64] |= np.uint64(1) << np.uint64(s % 64)

    def _packed(self, states: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for s, allowed in enumerate(states):
            out[allowed, s // 64] |= np.uint64(1) << np.uint64(s % 64)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns) booleans: the whole text matches the pattern."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        d = np.tile(self.start, (len(texts), 1))
        k = len(texts)
        for i in range(int(left[0]) if k else 0):
            k = int(np.searchsorted(-left[:k], -i, "left"))
            c = data[at[:k] + i]
            now = d[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:k] = (moved & self.enter[c]) | (now & self.stay[c])
        out = np.empty((len(texts), len(self.last)), bool)
        for p, s in enumerate(self.last):
            out[order, p] = (d[:, s // 64] >> np.uint64(s % 64)) & np.uint64(1) == 1
        return out


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[HostRule], globs: Sequence[GlobRule] = DEFAULT_GLOBS, default: str = "allow", url_col: str = "url", step: int = 20_000) -> DataFrame:
    """``pages`` with host, path, rule, glob and verdict.

    The fitting host rule with the longest name wins; else the first fitting
    glob; else ``default``, also for a null URL or one without ``://``.  No
    shuffle.  Equal URLs are judged alike; columns with the added names are
    replaced.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name()), r.verdict != "block", r.name()))
    globs = list(globs)
    escape = "".join  # host rules hold no wildcards: their literals are taken as they are
    for r in ranked:
        if set(r.name()) & set("*?"):
            raise ValueError(f"a host rule has no wildcards: {r.name()}")
    machine = Automaton([(escape(["*.", r.host, r.path, "**"]), False) for r in ranked] + [(g.glob, g.ignore_case) for g in globs])
    names = np.array([r.name() for r in ranked] + [None] * len(globs) + [None], object)
    shown = np.array([None] * len(ranked) + [g.glob for g in globs] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [g.verdict for g in globs] + [default], object)

    @F.pandas_udf("struct<rule string, glob string, verdict string>")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = []
        for i in range(0, len(host), step):
            texts = [f".{h}{p}".encode() for h, p in zip(host.iloc[i : i + step], path.iloc[i : i + step])]
            hits = np.column_stack([machine.matches(texts), np.ones(len(texts), bool)])
            found.append(hits.argmax(axis=1))
        k = np.concatenate(found) if found else np.zeros(0, int)
        return pd.DataFrame({"rule": names[k], "glob": shown[k], "verdict": verdicts[k]})

    out = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    out = out.withColumn("__judged", judged("host", "path"))
    return out.withColumns({k: F.col(f"__judged.{k}") for k in ("rule", "glob", "verdict")}).drop("__judged")
