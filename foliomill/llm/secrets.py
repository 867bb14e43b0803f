"""Secret scans: fixed patterns, and formats learned by grammar inference.

The fixed patterns give the base spans of every text. Their matches are also
the labelled credentials: a bounded sample of them, by kind, becomes a
prefix tree whose statistically compatible states are merged (Hoeffding test),
which gives one probabilistic automaton per kind. What text looks like otherwise
is a chain over character classes, counted over all candidates of the corpus.
A candidate is every maximal run of credential characters that is as long as the
shortest credential, and what is left of such a run beside a base span. All of
them are scored: one becomes a span of kind ``learned`` if its likelihood is that
of held-out labelled strings, within what its length allows, and far above the
chain's.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

# Fixed values of the base patterns, in the order in which kinds are listed.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "learned")
ASSIGN_CHARS = 8

#: Candidates are maximal runs of these characters, without dots and hyphens at the ends and with padding at the end only.
CANDIDATE = r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_][A-Za-z0-9+/_.-]{%d,}[A-Za-z0-9+/_]={0,2}" % (ASSIGN_CHARS - 2)
#: Distinct labelled credentials that fit one automaton, at most; of longer ones the first FIT_CHARS characters are learned, without an end.
SAMPLE = 400
FIT_CHARS = 128
#: Confidence of the merge test; how many natural log units a candidate must lie above the background;
#: and how many standard deviations its likelihood may lie below that of held-out credentials.
ALPHA = 0.05
MARGIN = 10.0
DEVIATIONS = 3.0
#: The least deviation: what the end of a string costs differs with its length, even where all characters are alike.
LEAST_SPREAD = 0.1
#: Distinct strings that a task holds or remembers.
HELD = 100_000

_assign, _access, _hex, _candidate = (re.compile(p, re.ASCII) for p in (ASSIGN, ACCESS, HEX, CANDIDATE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(start, string) of all candidates; what base spans leave of a run counts if it is long enough."""
    if not base:
        return [(m.start(), m[0]) for m in _candidate.finditer(text)]
    found, at = [], 0
    for start, end in [*((s, e) for s, _, e in base), (len(text), len(text))]:
        if start > at:
            found += [(at + m.start(), m[0]) for m in _candidate.finditer(text[at:start])]
        at = max(at, end)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


# -- grammar inference ------------------------------------------------------

_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
_TO_CLASS = {ord(c): k for k, chars in _CLASSES.items() for c in chars}
_SIZE = {k: len(chars) for k, chars in _CLASSES.items()}
_UNSEEN = math.log(1e-4)


class Automaton:
    """A probabilistic automaton over character classes, learned from strings."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.seen = [0]
        for sample in samples:
            self._add(sample[:FIT_CHARS].translate(_TO_CLASS), len(sample) <= FIT_CHARS)
        self._alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._score()

    def _add(self, word: str, whole: bool) -> None:
        state = 0
        self.seen[0] += 1
        for c in word:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.ends.append(0)
                self.seen.append(0)
            self.count[state][c] = self.count[state].get(c, 0) + 1
            state = self.next[state][c]
            self.seen[state] += 1
        self.ends[state] += whole

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self._alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.count[a].get(c, 0), self.seen[a], self.count[b].get(c, 0), self.seen[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree at ``tree`` to the state ``into``."""
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            self.seen[into] += self.seen[tree]
            self.ends[into] += self.ends[tree]
            for c, child in self.next[tree].items():
                self.count[into][c] = self.count[into].get(c, 0) + self.count[tree][c]
                if c in self.next[into]:
                    todo.append((self.next[into][c], child))
                else:
                    self.next[into][c] = child

    def _merge_states(self) -> None:
        kept, border = [0], [(0, c) for c in sorted(self.next[0])]
        while border:
            border.sort(key=lambda e: (-self.seen[self.next[e[0]][e[1]]], e))
            parent, c = border.pop(0)
            state = self.next[parent][c]
            for other in kept:
                if self._compatible(other, state):
                    self.next[parent][c] = other
                    self._fold(other, state)
                    break
            else:
                kept.append(state)
            known = set(kept)
            border = [(s, c) for s in kept for c in sorted(self.next[s]) if self.next[s][c] not in known]

    def _score(self) -> None:
        """Keep log probabilities of what can be reached; a class's share is spread over its characters."""
        self.log: list[dict[str, tuple[float, int]]] = [{} for _ in self.next]
        self.stop = [_UNSEEN] * len(self.next)
        todo, reached = [0], {0}
        while todo:
            s = todo.pop()
            for c, n in self.count[s].items():
                self.log[s][c] = (math.log(n / self.seen[s] / _SIZE.get(c, 1)), self.next[s][c])
            if self.ends[s]:
                self.stop[s] = math.log(self.ends[s] / self.seen[s])
            new = {*self.next[s].values()} - reached
            reached |= new
            todo += new
        del self.next, self.count, self.ends, self.seen

    def likelihood(self, word: str) -> float:
        """Natural log of the probability of the whole string."""
        state, total = 0, 0.0
        for c in word.translate(_TO_CLASS):
            step = self.log[state].get(c)
            if step is None:
                total += _UNSEEN - math.log(_SIZE.get(c, 1))
            else:
                total += step[0]
                state = step[1]
        return total + self.stop[state]


def steps(word: str) -> Iterator[str]:
    """The class pairs of a string, with its start and its end."""
    classes = f"^{word.translate(_TO_CLASS)}$"
    return map("".join, zip(classes, classes[1:]))


class Chain:
    """A chain over character classes, from counts of their pairs; unseen pairs count half."""

    def __init__(self, pairs: dict[str, int]):
        totals: Counter = Counter()
        for pair, n in pairs.items():
            totals[pair[0]] += n
        kinds = len(_CLASSES) + 7
        self.log = {pair: math.log((n + 0.5) / (totals[pair[0]] + 0.5 * kinds) / _SIZE.get(pair[1], 1)) for pair, n in pairs.items()}
        self.unseen = {c: math.log(0.5 / (totals[c] + 0.5 * kinds)) for c in [*totals, *_CLASSES, *"+/_.=-^"]}

    def likelihood(self, word: str) -> float:
        get, unseen = self.log.get, self.unseen
        return sum(get(pair) or unseen[pair[0]] - math.log(_SIZE.get(pair[1], 1)) for pair in steps(word))


class Model:
    """Automata by kind, each with the median and the deviation of the likelihood of a held-out character, and the background chain."""

    def __init__(self, labelled: dict[str, list[str]], background: dict[str, int]):
        self.background = Chain(background)
        self.kinds = []
        for kind in sorted(labelled):
            if known := labelled[kind]:
                learned, held_out = (known[::2], known[1::2]) if len(known) >= 20 else (known, known)
                automaton = Automaton(learned)
                scores = [(automaton.likelihood(x), len(x) + 1) for x in held_out]
                middle = median(s / n for s, n in scores)  # a few odd labels don't open the gate
                spread = 1.4826 * median(abs(s - middle * n) / math.sqrt(n) for s, n in scores)
                self.kinds.append((automaton, middle, max(spread, LEAST_SPREAD)))

    def accepts(self, word: str) -> bool:
        """Likelier than the background by a margin, and as likely as a credential of this length may be."""
        if not self.kinds:
            return False
        low, n = self.background.likelihood(word) + MARGIN, len(word) + 1
        for automaton, middle, spread in self.kinds:
            if automaton.likelihood(word) >= max(low, middle * n - DEVIATIONS * spread * math.sqrt(n)):
                return True
        return False

    def scorer(self):
        """``accepts`` that remembers a bounded number of short strings."""
        short = lru_cache(HELD)(self.accepts)
        return lambda word: short(word) if len(word) <= 64 else self.accepts(word)


# -- operator ---------------------------------------------------------------


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled credentials by kind, and class pairs of all candidates, with their counts."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in held], pa.string()), "value": pa.array([v for _, v in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    for batch in batches:
        words: Counter = Counter()
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            for start, kind, end in base:
                held[KINDS[kind], _assign.match(text, start)[1] if kind == 0 else text[start:end]] += 1
            words.update(word for _, word in candidates(text, base))
        for word, n in words.items():
            for pair in steps(word):
                held["pair", pair] += n
        if len(held) > HELD:
            yield flush()
            held.clear()
    yield flush()


def fit(texts: DataFrame) -> Model:
    """The model of all texts. Credentials are sampled by hash order, the same on every run; class pairs are counted in full."""
    gathered = texts.select("text").mapInArrow(_gather, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts = materialize(gathered, "credentials")
    samples = {}
    for kind in KINDS[:3]:
        rows = counts.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()
        samples[kind] = [r.value for r in rows]
    pairs = counts.filter("kind = 'pair'").collect()  # at most as many as there are pairs of classes
    return Model(samples, {r.value: r.n for r in pairs})


def _spans(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = model.value.scorer()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                out.append((base, sorted(base + [(a, 3, a + len(x)) for a, x in candidates(text, base) if accepts(x)])))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                **{f"n_{KINDS[k]}": pa.array([sum(x[1] == k for x in s) for _, s in out], pa.int64()) for k in range(4)},
                "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in out], pa.string()),
                "spans": pa.array([joined(s) for _, s in out], pa.string()),
            })

    return score


def secret_scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text, one row per input row.

    Reads ``doc_id`` and ``text``; returns doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_learned. Offsets are code points, ends exclusive. A
    null text counts as empty and has no spans. Without labelled credentials
    nothing is learned and only base spans are returned. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    scored = rows.mapInArrow(_spans(model), "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string")
    return scored.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned")


def _redact(model):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = model.value.scorer()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    cuts = [(s, e, k) for s, k, e in base]
                    cuts += [(a, a + len(x), 3) for a, x in candidates(text, base) if accepts(x)]
                    parts, at = [], 0
                    for s, e, k in sorted(cuts, key=lambda x: (x[0], -x[1])):
                        if s >= at:
                            parts += [text[at:s], f"[{KINDS[k]}]"]
                        at = max(at, e)
                    text = "".join(parts) + text[at:]
                out.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    return redact


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The input rows with each secret replaced by its kind in brackets; n_chars follows. Null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(text_or_empty().alias("text"))))
    out = docs.mapInArrow(_redact(model), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
