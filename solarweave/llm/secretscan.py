"""Secret scans: fixed patterns, and a character convolutional network over every candidate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, give_back, in_batches, pieces
from solarweave.storage import stored

#: Fixed values of the query: the base kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the network judges: all runs of at least 12 such characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")

#: Characters before, of, and after a candidate that one look takes; longer candidates take several looks.
BEFORE, INSIDE, AFTER = 16, 48, 8
WIDTH, EMBED, FILTERS, REACH = BEFORE + INSIDE + AFTER, 8, 16, 5
CHARS = "\0 \nabcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-:\"'@,;()[]{}<>&?%#"
CODES = {c: i + 1 for i, c in enumerate(CHARS)}
#: Places of the convolution, and whether each of the characters under it is one of the candidate's.
PLACES = WIDTH - REACH + 1
WITHIN = ((np.arange(PLACES)[:, None] + np.arange(REACH) >= BEFORE) & (np.arange(PLACES)[:, None] + np.arange(REACH) < BEFORE + INSIDE)).astype(np.float64)
#: Share of confirmed findings that the threshold must keep; of so many parts of the findings one is kept for it, counted in steps of a logit.
RECALL, FIFTHS, STEPS = 0.98, 5, 1024
#: Findings that descend together, passes over all of them, steps of each part in a pass at least, examples a step, and rate.
EACH, ROUNDS, LEAST_STEPS, BATCH, RATE = 1 << 15, 3, 100, 128, 0.004
#: Share of the weight that made examples have, and greatest weight of a finding; tasks that write the dealt findings at most.
MADE_SHARE, HEAVIEST, MOST_TASKS = 2 / 7, 64.0, 512
#: From this probability on a finding of no pattern is not an example.
UNSURE = 0.95


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    low, found = text.lower(), []
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of every candidate, dots at its end left out."""
    out = []
    for m in CANDIDATE.finditer(text):
        end = m.end() - len(m[0]) + len(m[0].rstrip("."))
        if end - m.start() >= 12:
            out.append((m.start(), end))
    return out


def looks(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character codes of a candidate with its surroundings, in as many looks as it needs."""
    out = []
    for at in range(start, end, INSIDE):
        stop = min(end, at + INSIDE)
        codes = np.zeros(WIDTH, np.int8)
        left, own, right = text[max(0, at - BEFORE) : at], text[at:stop], text[stop : stop + AFTER]
        for begin, part in ((BEFORE - len(left), left), (BEFORE, own), (BEFORE + INSIDE, right)):
            codes[begin : begin + len(part)] = [CODES.get(c, 0) for c in part]
        out.append(codes)
    return out


@dataclass
class Network:
    """Embedding, one convolution, the greatest and the mean response in the candidate, a logistic layer."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0

    def forward(self, codes: np.ndarray):
        """Codes, responses, where each filter's is greatest, shares of the mean, pooled responses, logits. A place's response sums one row of a table for each of REACH characters."""
        codes = codes.astype(np.intp)
        kernel = self.kernel.reshape(REACH, EMBED + 2, FILTERS)
        table = self.embed @ kernel[:, :EMBED]
        table[:, 1:] += kernel[:, EMBED + 1, None]
        table = table.astype(np.float32)
        h = np.tile((WITHIN @ kernel[:, EMBED] + self.shift).astype(np.float32), (len(codes), 1, 1))
        for k in range(REACH):
            h += np.take(table[k], codes[:, k : k + PLACES], axis=0)
        np.maximum(h, 0, out=h)
        best = h.argmax(axis=1)
        inside = (codes[:, REACH // 2 : WIDTH - REACH // 2] > 0) & (WITHIN[:, REACH // 2] > 0)
        share = (inside / np.maximum(1, inside.sum(axis=1, keepdims=True))).astype(np.float32)
        pooled = np.concatenate((np.take_along_axis(h, best[:, None, :], 1)[:, 0], (share[:, None] @ h)[:, 0]), axis=1).astype(np.float64)
        return codes, h, best, share, pooled, pooled @ self.out + self.bias

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted mean loss by name, and of the bias."""
        codes, h, best, share, pooled, z = self.forward(codes)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
        gp = (g[:, None] * self.out).astype(np.float32)
        gh = share[:, :, None] * gp[:, None, FILTERS:]
        np.put_along_axis(gh, best[:, None, :], np.take_along_axis(gh, best[:, None, :], 1) + gp[:, None, :FILTERS], 1)
        gh *= h > 0
        kernel, places = self.kernel.reshape(REACH, EMBED + 2, FILTERS), gh.sum(axis=0, dtype=np.float64)
        at, size = codes[:, :, None] * FILTERS + np.arange(FILTERS), (len(CHARS) + 1) * FILTERS
        table = np.stack([np.bincount(at[:, k : k + PLACES].ravel(), gh.ravel(), size).reshape(-1, FILTERS) for k in range(REACH)])
        own = np.concatenate((self.embed.T @ table, (WITHIN.T @ places)[:, None], table[:, 1:].sum(axis=1, keepdims=True)), axis=1)
        return {"embed": (table @ kernel[:, :EMBED].transpose(0, 2, 1)).sum(axis=0), "kernel": own.reshape(-1, FILTERS), "shift": places.sum(axis=0), "out": pooled.T @ g}, float(g.sum())

    def descend(self, batches: Iterable[np.ndarray], codes: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """Adam over batches of indices."""
        state: dict[str, tuple] = {}
        for step, some in enumerate(batches, 1):
            grads, bias = self.gradients(codes[some], y[some], weight[some])
            for n, g in grads.items():
                m, v = state.get(n, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
                state[n] = m, v
                setattr(self, n, getattr(self, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
            self.bias -= rate * 10 * bias

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt's two parameters, with smoothed labels, of n findings at each logit z and label y."""
        confirmed, every = n[y == 1].sum(), n.sum()
        aim = np.where(y == 1, (confirmed + 1) / (confirmed + 2), 1 / (every - confirmed + 2))
        for _ in range(200):
            off = 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))) - aim
            self.slope -= 0.1 * (off * z * n).sum() / every / max(1.0, (z * z * n).sum() / every)
            self.offset -= 0.1 * (off * n).sum() / every

    def packed(self) -> np.ndarray:
        return np.concatenate((self.embed.ravel(), self.kernel.ravel(), self.shift, self.out, [self.bias]))

    def copied(self, values: np.ndarray | None = None) -> Network:
        """This network, with the values of another's packed if given."""
        of = (self.embed, self.kernel, self.shift, self.out, np.zeros(1))
        ends = np.cumsum([v.size for v in of])[:-1]
        own = [v.reshape(o.shape).copy() for v, o in zip(np.split(self.packed() if values is None else values, ends), of, strict=True)]
        return Network(*own[:4], float(own[4][0]), self.slope, self.offset, self.threshold)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.forward(codes)[-1] + self.offset, -30, 30)))


def train(codes: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.01, seed: int = 9) -> Network:
    """A network on labelled looks by Adam; a fifth is kept to calibrate it and to set its threshold.

    The threshold is the highest that keeps RECALL of the confirmed findings of that fifth.
    With one label alone nothing is ever found.
    """
    rng = np.random.default_rng(seed)
    inputs = (EMBED + 2) * REACH
    net = Network(rng.normal(0, 0.3, (len(CHARS) + 1, EMBED)), rng.normal(0, inputs**-0.5, (inputs, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)
    if len(set(y.tolist())) < 2:
        return net
    order = rng.permutation(len(y))
    held, own = order[: max(2, len(y) // 5)], order[max(2, len(y) // 5) :]
    net.descend((b for _ in range(epochs) for b in np.array_split(rng.permutation(own), max(1, len(own) // 64))), codes, y, np.ones(len(y)), rate)
    t = y[held]
    net.calibrate(net.forward(codes[held])[-1], t, np.ones(len(held)))
    confirmed = np.sort(net.probability(codes[held])[t == 1])
    net.threshold = float(confirmed[int((1 - RECALL) * len(confirmed))]) if len(confirmed) else 0.5
    return net


def _made(rng: np.random.Generator) -> tuple[dict[str, str], dict[str, str]]:
    """One run of each shape: keys, and what isn't one."""
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = small + small.upper()
    of = lambda chars, k: "".join(rng.choice(list(chars), k))
    word = lambda: of(small, rng.integers(3, 9))
    spoken = lambda k: "".join(of("bcdfghklmnprstvw", 1) + of("aeiou", 1) for _ in range(k))
    pieces = ("th", "in", "er", "on", "an", "re", "nd", "at", "ou", "ed", "ha", "to", "or", "it", "is", "hi", "es", "ng", "st", "tion", "ment", "eau", "ung", "sch", "ich", "ein", "que", "ando", "mente", "cion", "os", "as", "de", "la")
    joined = lambda k: "".join(rng.choice(pieces, k))
    size, long = int(rng.integers(20, 48)), int(rng.integers(6, 12))
    keys = {
        "hex": of("0123456789abcdef", size), "HEX": of("0123456789ABCDEF", size), "mixed": of(both + digits, size), "base64": of(both + digits + "+/", size),
        "access": f"AKIA{of(small.upper() + digits, 16)}", "prefixed": f"{word()[:3]}_{of(both + digits, size)}", "letters": of(both, size - 4),
        "dotted": f"{of(both + digits, size // 2)}.{of(both + digits + '-_', size)}", "base32": of(small.upper() + "234567", size),
    }
    others = {
        "date": f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}", "address": ".".join(str(x) for x in rng.integers(100, 256, 4)), "host": f"mail{rng.integers(0, 99)}.{word()}.com",
        "file": f"{word()}{word()}.{rng.integers(1, 99)}", "number": of(digits, 16), "name": f"{word()}_{word()}_{rng.integers(1, 9999)}", "version": f"{word()}-{word()}-v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}",
        "path": f"{word()}/{word()}/{rng.integers(1, 999)}.html", "word": spoken(8), "hyphen": f"{spoken(3)}-{spoken(4)}", "camel": f"{spoken(3).title()}{spoken(3).title()}{spoken(2).title()}", "snake": f"{spoken(3)}_{spoken(3)}.{spoken(2)}",
        "slashes": f"{spoken(2)}/{spoken(3)}/{spoken(3)}", "WORD": spoken(8).upper(), "rule": of("-=_.", 1) * size, "longword": joined(long), "LONGWORD": joined(long).upper(), "Longword": joined(long).title(), "CAPITALS": of(small.upper(), rng.integers(12, 26)),
        "sentence": f"{joined(4)}.{joined(4).title()}", "SNAKE": f"{joined(3)}_{joined(3)}_{joined(2)}".upper(), "again": joined(2) * 6,
    }
    return keys, others


def made_examples(n: int = 1200, seed: int = 4, only: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """n looks of either label, made by rule: keys of usual shapes, with digits or letters alone, and numbers,
    dates, hosts, versions, long words of any case and names that aren't. only and without name shapes of keys."""
    rng, codes, y = np.random.default_rng(seed), [], []
    for i in range(n):
        for label, runs in zip((1, 0), _made(rng), strict=True):
            names = [k for k in runs if not label or (k in only or not only) and k not in without]
            before, own = rng.choice(("see ", "the key is ", "", "a note: ", "with (")), runs[names[i % len(names)]]
            text = before + own + rng.choice((" and more", ".", ", then", "\n", ")"))
            codes.append(looks(text, len(before), len(before) + len(own))[0])
            y.append(label)
    return np.stack(codes), np.array(y, np.float64)


def examples(text: str) -> list[tuple[int, bytes]]:
    """Labelled looks of one text. A candidate that a pattern finds is confirmed, one that none
    finds is not. Bare numbers, and what a pattern finds only in lower case, have no label."""
    base, low, out = base_spans(text), text.lower(), []
    also = base_spans(low) if len(low) == len(text) else base
    for start, end in candidates(text):
        over = [s for s in base if s[0] < end and start < s[2]]
        value = text[start:end]
        if over:
            if not value.isdigit():
                out.append((1, looks(text, start, end)[0].tobytes()))
        elif not any(s[0] < end and start < s[2] for s in also) and not (value.isdigit() and len(value) >= 16):
            out.append((0, looks(text, start, end)[0].tobytes()))
    return out


def _logits(net: Network, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([net.forward(codes[k : k + 512])[-1] for k in range(0, len(codes), 512)] or [np.zeros(0)])


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, WIDTH)


def _trained(net: Network, findings: DataFrame, made: np.ndarray, label: np.ndarray, weight: tuple[float, float], rate: float, seed: int) -> Network:
    """net after a pass over all findings (part, y, look; parts in one piece): each part descends from net by itself, and the results' mean counts.

    The examples made go along with each part, as MADE_SHARE of its weight.
    """

    def one(part: int, looks: list[np.ndarray], labels: list[np.ndarray]) -> dict:
        codes, y = np.concatenate((*looks, made)), np.concatenate((*labels, label))
        n = len(y) - len(made)
        own = np.concatenate((np.array(weight)[y[:n].astype(int)], np.full(len(made), MADE_SHARE / (1 - MADE_SHARE) * n / len(made))))
        rng, local = np.random.default_rng((seed, part)), net.copied()
        steps = -(-len(y) // BATCH)
        local.descend((b for _ in range(-(-LEAST_STEPS // steps)) for b in np.array_split(rng.permutation(len(y)), steps)), codes, y, own, rate)
        return {"part": part, "n": n, "net": local.packed().astype(np.float32).tobytes()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("net", pa.binary())])
        now, looks, labels = None, [], []
        for batch in batches:
            parts, codes, y = np.asarray(batch.column("part")), _codes(batch.column("look")), np.asarray(batch.column("y")).astype(np.float64)
            ends = np.flatnonzero(np.diff(parts)) + 1
            for a, b in zip([0, *ends], [*ends, len(parts)], strict=True):
                if a < b and parts[a] != now:
                    if looks:
                        yield pa.RecordBatch.from_pylist([one(now, looks, labels)], schema)
                    now, looks, labels = int(parts[a]), [], []
                looks.append(codes[a:b])
                labels.append(y[a:b])
        if looks and now is not None:
            yield pa.RecordBatch.from_pylist([one(now, looks, labels)], schema)
        give_back()

    rows = sorted(tuple(r) for r in in_batches(findings.select("part", "y", "look"), run, "part long, n long, net binary").collect())
    mean = np.average([np.frombuffer(r[2], np.float32).astype(np.float64) for r in rows], axis=0, weights=[r[1] for r in rows])
    return net.copied(mean)


def _tallied(net: Network, held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, y, n): how many of all held findings have each label and logit, in steps of 1 / STEPS rounded down."""

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            return {"y": batch.column("y"), "z": np.floor(np.clip(_logits(net, _codes(batch.column("look"))), -30, 30) * STEPS).astype(np.int32)}

        return each

    rows = by_batch(held.select("y", "look"), "y int, z int", start).groupBy("z", "y").count().toPandas().sort_values(["z", "y"])
    return rows.z.to_numpy(np.float64) / STEPS, rows.y.to_numpy(np.float64), rows["count"].to_numpy(np.float64)


def _keeping(p: np.ndarray, n: np.ndarray) -> float:
    """The highest of some probabilities at or above which RECALL of the n that have each lie."""
    order = np.argsort(p)
    return float(p[order][np.searchsorted(np.cumsum(n[order]), int((1 - RECALL) * n.sum()), "right")])


def fit(docs: DataFrame, text: str = "text") -> Network:
    """A network from all distinct findings in docs and the made examples.

    All texts are scanned, once, and distinct findings are written, dealt by hash to parts of about
    EACH. It starts as the network of the made examples alone; in each of ROUNDS passes every part
    trains a copy, and the copies' mean goes on. Labels weigh the same, up to HEAVIEST. A fifth of the
    findings, by hash, is kept: all of it is counted by logit to calibrate the network and to set the threshold,
    which keeps RECALL of its confirmed findings and of the made keys that were kept. What no
    pattern finds may be a key all the same: such a finding is no example if the
    network of the made examples is all but certain of it. An empty table leaves the made examples.
    """
    made = made_examples()
    first = train(*made)

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            got = [g for g in {x for t in batch.column("t").to_pylist() if t for x in examples(t)}]
            codes = np.frombuffer(b"".join(g[1] for g in got), np.int8).reshape(-1, WIDTH)
            sure = np.concatenate([first.probability(codes[k : k + 512]) < UNSURE for k in range(0, len(got), 512)] or [[]])
            got = [g for g, s in zip(got, sure, strict=True) if s or g[0]]
            return {"y": [g[0] for g in got], "look": [g[1] for g in got]}

        return each

    hashed = F.xxhash64("look")
    distinct = stored(by_batch(docs.select(F.col(f"`{text}`").alias("t")), "y int, look binary", start).distinct().withColumn("held", F.pmod(hashed, F.lit(FIFTHS)) == 0), "findings")
    count = {(r.y, r.held): r["count"] for r in distinct.groupBy("y", "held").count().collect()}
    own = [count.get((y, False), 0) for y in (0, 1)]
    net, total = first, sum(own)
    if total:
        parts = -(-total // EACH)
        dealt = distinct.filter("not held").withColumn("part", F.pmod(F.floor(hashed / FIFTHS), F.lit(parts)))
        dealt = stored(dealt.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part", "look", "y"), "dealt")
        weight = tuple(min(HEAVIEST, total / (2 * n)) if min(own) else 1.0 for n in own)
        own = [v[np.arange(len(v)) % FIFTHS > 0] for v in made]
        for k in range(ROUNDS):
            net = _trained(net, dealt, *own, weight, RATE / (k + 1), k)
    if count:
        z, y, n = _tallied(net, distinct.filter("held"))
        codes, label = (v[np.arange(len(v)) % FIFTHS == 0] for v in made)
        kept = _logits(net, codes)
        net.slope, net.offset = 1.0, 0.0
        net.calibrate(np.concatenate((z, kept)), np.concatenate((y, label)), np.concatenate((n, np.ones(len(kept)))))
        p = lambda z: 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -30, 30)))
        net.threshold = min(_keeping(p(v), m) for v, m in ((z[y == 1], n[y == 1]), (kept[label == 1], np.ones(int(label.sum())))) if len(v))
    give_back()
    return net


def all_spans(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's base spans and of the candidates that the network adds.

    A candidate within a base span adds nothing; one that extends past it is judged as a whole, and
    the base span stays. Of several looks the highest counts.
    """
    out, codes, owners = [], [], []
    for n, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        for start, end in candidates(text):
            if not any(s[0] <= start and end <= s[2] for s in base):
                for look in looks(text, start, end):
                    codes.append(look)
                    owners.append((n, start, end))
    added: dict[tuple, float] = {}
    for at in range(0, len(codes), 512):
        for owner, p in zip(owners[at : at + 512], net.probability(np.stack(codes[at : at + 512])), strict=False):
            added[owner] = max(added.get(owner, 0.0), float(p))
    for (n, start, end), p in added.items():
        if p >= net.threshold:
            out[n] = [*out[n], (start, 3, end)]
    return [sorted(s) for s in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found_secrets(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, n_assign, n_access, n_hex, n_cnn, base_sha256 and spans of its whole text.

    Spans are kind:start:end in code points, by start and then kind. Null texts count as
    empty: no spans, the digest of nothing. No shuffle; repeated rows come out repeated.
    """

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            spans = all_spans([t or "" for t in batch.column("t").to_pylist()], net)
            out = {f"n_{k}": [sum(s[1] == i for s in own) for own in spans] for i, k in enumerate(KINDS)}
            return {"k": batch.column("k"), **out, "base_sha256": [hashlib.sha256(joined([s for s in own if s[1] < 3]).encode()).hexdigest() for own in spans], "spans": [joined(own) for own in spans]}

        return each

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    schema = f"k {rows.schema['k'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return by_batch(rows, schema, start).withColumnRenamed("k", key)


def redacted(docs: DataFrame, net: Network, text: str = "text", mark: str = "[secret]", chars: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by mark (overlapping spans by one), all other columns as they are.

    Where a text changes, the column chars, if docs has it, becomes its length.
    """
    n = docs.columns.index(chars) if chars in docs.columns else -1

    def run(batches):
        for batch in (p for b in batches for p in pieces(b)):
            texts = batch.column(text).to_pylist()
            lengths = batch.column(n).to_pylist() if n >= 0 else []
            for i, own in enumerate(all_spans([t or "" for t in texts], net)):
                if own:
                    parts, at = [], 0
                    for a, _, b in own:
                        if a >= at:
                            parts += (texts[i][at:a], mark)
                        at = max(at, b)
                    texts[i] = "".join([*parts, texts[i][at:]])
                    if n >= 0:
                        lengths[i] = len(texts[i])
            batch = batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(texts, batch.schema.field(text).type))
            yield batch.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type)) if n >= 0 else batch
        give_back()

    return in_batches(docs, run, docs.schema)
