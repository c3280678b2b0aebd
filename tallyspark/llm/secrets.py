"""Secret scans: three fixed patterns, and formats inferred from the credentials they find.

Grammar inference: credentials labelled with their kind are written as strings of symbols, one for each
character: a sign is its own symbol, and all characters of a run of letters and digits have the symbol
of the characters that the run uses (lower-case hexadecimal, upper case and digits, ...), so that
tokens of one format share their path. They go into a prefix tree with counts. States whose outgoing
and final frequencies agree within a Hoeffding bound, as those of all states below them do, are
merged, red states first, folding their subtrees; that gives a probabilistic automaton for each kind,
whose moves also hold how often each character was seen. One more is learned from ordinary tokens.
Every run of ``SHORTEST`` credential characters is a candidate and is scored; it is a secret if an automaton of
credentials accepts it and its log-likelihood beats that of the ordinary tokens by ``MARGIN``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import flat

# The patterns and least lengths of the three kinds.
KINDS = ("assign", "access", "hex", "auto")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Shortest candidate of the inferred formats, least gain in nats over ordinary tokens, credentials and ordinary tokens to learn from, and the merge test's confidence.
SHORTEST, MARGIN, EXAMPLES, ALPHA, PARTS = 12, 12.0, 1000, 0.5, 16
_CHARS = np.zeros(256, bool)
_CHARS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = _DIGIT.copy()
_HEX[97:103] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
#: How many characters each symbol of a run stands for; signs stand for themselves.
SIZES = {"d": 10, "h": 16, "H": 16, "a": 36, "A": 36, "m": 62, "l": 26, "u": 26, "c": 52}
#: All credential characters; the weight of an end never seen; the number and the share of ordinary tokens below which a form that a credential format accepts isn't taken for ordinary.
ALL, UNSEEN, FEWEST, RARE = 68, 0.5, 3, 0.01
_RUN = re.compile(r"[A-Za-z0-9]+")
_KINDS = tuple((k, re.compile(p)) for k, p in (("d", "[0-9]+"), ("l", "[a-z]+"), ("u", "[A-Z]+"), ("c", "[A-Za-z]+"), ("h", "[0-9a-f]+"), ("H", "[0-9A-F]+"), ("a", "[0-9a-z]+"), ("A", "[0-9A-Z]+"), ("m", "[0-9A-Za-z]+")))


def symbols(token: str) -> str:
    """A symbol for each character: of a run of letters and digits, the first kind that has all of it; a sign is itself."""
    return _RUN.sub(lambda m: next(k for k, p in _KINDS if p.fullmatch(m[0])) * len(m[0]), token)


class Format:
    """A probabilistic automaton: moves[state][symbol] = (next state, log probability, log probability of each character, that of one never seen there); ends[state] = log probability of ending there."""

    def __init__(self, moves: list[dict[str, tuple[int, float, dict[str, float], float]]], ends: list[float]):
        self.moves, self.ends = moves, ends

    def score(self, token: str) -> float:
        """The log-likelihood of a token; minus infinity if the automaton doesn't accept it."""
        at, total = 0, 0.0
        for x, c in zip(token, symbols(token), strict=True):
            if c not in self.moves[at]:
                return -math.inf
            at, p, seen, other = self.moves[at][c]
            total += p + seen.get(x, other)
        return total + self.ends[at]


def infer(tokens: list[str], alpha: float = ALPHA) -> Format:
    """ALERGIA: merges compatible states of the prefix tree of ``tokens``, red and blue, in order of discovery.

    A red state's subtree must agree with the blue one's state by state, as far as both go. Characters
    have add-one estimates over those of their symbol.
    """
    kids: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    used: list[dict[str, Counter[str]]] = [{}]
    final = [0]
    for token in sorted(tokens):
        at = 0
        for x, c in zip(token, symbols(token), strict=True):
            if c not in kids[at]:
                kids[at][c] = len(kids)
                kids.append({})
                count.append({})
                used.append({})
                final.append(0)
            count[at][c] = count[at].get(c, 0) + 1
            used[at].setdefault(c, Counter())[x] += 1
            at = kids[at][c]
        final[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def size(q: int) -> int:
        return final[q] + sum(count[q].values())

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(r: int, b: int) -> bool:
        todo, seen = [(r, b)], set()
        while todo:
            p, q = todo.pop()
            n, m = size(p), size(q)
            if not n or not m or (p, q) in seen:
                continue
            seen.add((p, q))
            if differ(final[p], n, final[q], m) or any(differ(count[p].get(c, 0), n, count[q].get(c, 0), m) for c in count[p].keys() | count[q].keys()):
                return False
            todo += [(kids[p][c], kids[q][c]) for c in kids[p].keys() & kids[q].keys() if kids[p][c] != kids[q][c]]
        return True

    def fold(r: int, b: int) -> None:
        todo = [(r, b)]
        while todo:
            p, q = todo.pop()
            final[p] += final[q]
            for c, k in kids[q].items():
                count[p][c] = count[p].get(c, 0) + count[q][c]
                used[p].setdefault(c, Counter()).update(used[q][c])
                if c in kids[p]:
                    todo.append((kids[p][c], k))
                else:
                    kids[p][c] = k

    red, blue = [0], sorted((k, 0, c) for c, k in kids[0].items())
    while blue:
        b, parent, c = blue.pop(0)
        for r in red:
            if compatible(r, b):
                kids[parent][c] = r
                fold(r, b)
                break
        else:
            red.append(b)
        known = set(red)
        blue = sorted({kids[r][c]: (kids[r][c], r, c) for r in red for c in kids[r] if kids[r][c] not in known}.values())
    place = {r: i for i, r in enumerate(red)}
    moves, ends = [], []
    for r in red:
        n = size(r)
        moves.append({})
        for c, k in kids[r].items():
            m, every = count[r][c], SIZES.get(c, 1)
            moves[-1][c] = (place[k], math.log(m / (n + UNSEEN)), {x: math.log((y + 1) / (m + every)) for x, y in used[r][c].items()}, -math.log(m + every))
        ends.append(math.log((final[r] + UNSEEN) / (n + UNSEEN)))
    return Format(moves, ends)


def scan(texts: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, str]], list[tuple[int, int]]]]:
    """(text number, text, base spans, candidates) for each text with any; spans in code points.

    Only texts that can hold a match reach the patterns: those with a run of 24 hexadecimal digits,
    "AKIA", or a ":" or "=" after a keyword's last letter (quotes and blanks between).
    """
    buf, off = flat.flat(texts)
    if not len(buf):
        return
    starts, ends = flat.runs(_HEX[buf], off)
    wanted = [starts[ends - starts >= LEAST["hex"]]]
    if len(buf) > 3:
        wanted.append(np.flatnonzero((buf[:-3] == 65) & (buf[1:-2] == 75) & (buf[2:-1] == 73) & (buf[3:] == 65)))
    signs = np.flatnonzero((buf == 58) | (buf == 61))
    back = signs - 1
    while len(back) and (blank := (back >= 0) & (buf[np.maximum(back, 0)] == 32)).any():
        back = back - blank
    back = back - ((back >= 0) & np.isin(buf[np.maximum(back, 0)], (34, 39)))
    wanted.append(signs[(back >= 0) & np.isin(buf[np.maximum(back, 0)] | 0x20, np.frombuffer(b"dtny", np.uint8))])
    fixed = np.zeros(len(off) - 1, bool)
    fixed[flat.owner(off, np.concatenate(wanted))] = True
    starts, ends = flat.runs(_CHARS[buf], off)
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    of = flat.owner(off, starts)
    # to code points: bytes that begin a character, up to each end
    upto = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    first, last = (upto[starts] - upto[off[of]]).tolist(), (upto[ends] - upto[off[of]]).tolist()
    cut = np.searchsorted(of, np.arange(len(off))).tolist()
    for i in np.flatnonzero(fixed | (np.diff(cut) > 0)).tolist():
        text, spans = texts[i].as_py(), []
        if fixed[i]:
            spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
            spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
            spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
            spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        yield i, text, spans, list(zip(first[cut[i] : cut[i + 1]], last[cut[i] : cut[i + 1]], strict=True))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def learn(docs: DataFrame, text: str = "text", examples: int = EXAMPLES) -> dict[str, Format]:
    """A format for each kind and one for "ordinary" tokens, from at most ``examples`` distinct strings of each (the bound), those of the lowest hash.

    Credentials are what the fixed patterns find (of an assignment, its value); ordinary tokens are
    candidates that no pattern touches, but for those that a format of credentials accepts and whose form fewer than ``FEWEST`` or ``RARE`` of
    them have, or no more than credentials do: they may be credentials without a label. Every text is read. Without ordinary tokens, all characters
    have even odds.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for piece in flat.pieces(batches, "__text"):
            for _, t, spans, candidates in scan(piece.column("__text")):
                for a, b, kind in spans:
                    seen[kind, ASSIGN.match(t, a)[2] if kind == "assign" else t[a:b]] += 1
                for a, b in candidates:
                    if not any(x < b and a < y for x, y, _ in spans):
                        seen["ordinary", t[a:b]] += 1
            if len(seen) > 50_000:
                yield flat.table({"kind": [k for k, _ in seen], "token": [t for _, t in seen]})
                seen.clear()
        yield flat.table({"kind": pa.array([k for k, _ in seen], pa.string()), "token": pa.array([t for _, t in seen], pa.string())})

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = {}
        for batch in batches:
            for kind, token, h in zip(*(batch.column(c).to_pylist() for c in ("kind", "token", "h")), strict=True):
                best.setdefault(kind, {})[token] = h
            for kind, few in best.items():
                best[kind] = dict(sorted(few.items(), key=lambda x: (x[1], x[0]))[:examples])
        rows = [(k, t, h) for k, few in best.items() for t, h in few.items()]
        yield flat.table({"kind": pa.array([r[0] for r in rows], pa.string()), "token": pa.array([r[1] for r in rows], pa.string()), "h": pa.array([r[2] for r in rows], pa.int64())})

    schema = "kind string, token string, h long"
    rows = docs.select(F.col(text).alias("__text")).mapInArrow(found, "kind string, token string").withColumn("h", F.xxhash64("token"))
    rows = rows.mapInArrow(lowest, schema).repartition(PARTS, "h").mapInArrow(lowest, schema)  # examples * kinds * PARTS rows at most
    out: dict[str, list[str]] = {}
    for r in sorted({(r.kind, r.h, r.token) for r in rows.collect()}):
        out.setdefault(r[0], []).append(r[2])
    plain = out.pop("ordinary", [])[:examples]
    formats = {k: infer(sorted(tokens[:examples])) for k, tokens in out.items()}
    forms = Counter(map(symbols, plain))
    known = Counter(symbols(t) for tokens in out.values() for t in tokens)
    common = {x for x, n in forms.items() if n >= max(FEWEST, RARE * len(plain)) and n > known[x]}
    plain = [t for t in plain if symbols(t) in common or all(f.score(t) == -math.inf for f in formats.values())]
    return formats | ({"ordinary": infer(sorted(plain))} if plain else {})


def gain(formats: dict[str, Format], token: str) -> float:
    """By how much a token's likelihood under the best format of credentials beats that as an ordinary one; minus infinity if no format accepts it.

    What the ordinary tokens' automaton doesn't accept has even odds over all characters, and for the end.
    """
    best = max((f.score(token) for k, f in formats.items() if k != "ordinary"), default=-math.inf)
    if best == -math.inf:
        return best
    plain = formats["ordinary"].score(token) if "ordinary" in formats else -math.inf
    return best - max(plain, -(len(token) + 1) * math.log(ALL + 1))


def spans(docs: DataFrame, formats: dict[str, Format], text: str = "text", redact: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_auto, n_scored, n_likely, base_spans, spans, for each row; with ``redact`` also redacted: the text, spans replaced by it.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. n_scored counts the
    candidates, all of which the formats score, and n_likely those that they take for secrets. One
    that a base span touches is no span of its own. Null and empty texts have no spans (redacted stays
    null for null); repeated rows give repeated rows; of other columns only ``carry`` is read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in flat.pieces(batches, "__text"):
            n = piece.num_rows
            counts = {k: np.zeros(n, np.int64) for k in (*KINDS, "scored", "likely")}
            base, every, new = [""] * n, [""] * n, {}
            gains: dict[str, float] = {}
            for i, t, fixed, candidates in scan(piece.column("__text")):
                more = []
                for a, b in candidates:
                    if (token := t[a:b]) not in gains:
                        gains[token] = gain(formats, token)
                    if gains[token] >= MARGIN:
                        counts["likely"][i] += 1
                        if not any(x < b and a < y for x, y, _ in fixed):
                            more.append((a, b, "auto"))
                counts["scored"][i] = len(candidates)
                both = sorted(fixed + more, key=lambda s: (s[0], KINDS.index(s[2])))
                base[i], every[i] = joined(fixed), joined(both)
                for k, m in Counter(k for _, _, k in both).items():
                    counts[k][i] = m
                if redact is not None and both:
                    out, at = [], 0
                    for a, b, _ in both:
                        if a >= at:
                            out += [t[at:a], redact]
                        at = max(at, b)
                    new[i] = "".join([*out, t[at:]])
            made = {"doc_id": piece.column("doc_id")} | {c: piece.column(c) for c in carry} | {f"n_{k}": v for k, v in counts.items()} | {"base_spans": pa.array(base, pa.string()), "spans": pa.array(every, pa.string())}
            if redact is not None:
                texts = piece.column("__text")
                if new:
                    texts = pa.array([new.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
                made["redacted"] = texts
            yield flat.table(made)

    fields = [docs.schema[c] for c in ("doc_id", *carry)]
    return docs.select("doc_id", *carry, F.col(text).alias("__text")).mapInArrow(find, StructType([*fields, *StructType.fromDDL("n_assign long, n_access long, n_hex long, n_auto long, n_scored long, n_likely long, base_spans string, spans string" + ", redacted string" * (redact is not None))]))


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
