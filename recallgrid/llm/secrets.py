"""Secret scans: a character convolutional network in numpy over every candidate string and its surroundings.

Candidates are all runs of 16 or more characters of the key alphabets. The network sees 64 characters of a candidate with
24 characters on either side. A longer candidate is looked at several times, and the highest score is its own: its first
and last 32 characters together, windows of 64 characters, every 32, that cover all of it (but for those without a letter
or digit), and its own runs of 16 or more letters and digits. The network is trained on findings labelled by
construction (formats of keys and of things that look like keys) and by rule (a bounded sample of the corpus's own
candidates), calibrated on held-out findings, and cut at the largest threshold that keeps the wanted recall there.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm._arrow import IS_DIGIT, IS_LOWER, IS_UPPER, bounded_sample, fresh, row_slices, utf8_parts

MIN_RUN, SIDE, HALF = 16, 24, 32
LENGTH = 2 * SIDE + 2 * HALF
ALNUM = IS_DIGIT | IS_LOWER | IS_UPPER
IN_RUN = ALNUM | np.isin(np.arange(256), [ord(c) for c in "+/_=-"])
SYMBOLS, EMBED, WIDTH, FILTERS, HIDDEN = 98, 8, 5, 24, 16
SAMPLE_DOCS, SAMPLE_TEXT_BYTES, RULE_ROWS = 400, 1 << 20, 4000


def candidates(raw: np.ndarray, off: np.ndarray, alphabet: np.ndarray = IN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, begin, end) of the runs, as places in ``raw``."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = alphabet[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    ok = end - start >= MIN_RUN
    start, end = start[ok], end[ok]
    return np.searchsorted(off, start, side="right") - 1, start, end


_SYM = np.full(256, 96, np.uint8)
_SYM[32:127] = np.arange(1, 96)


def windows(raw: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (0: nothing) and a zone for each place: 0 before, 1 candidate, 2 after, 3 nothing."""
    n = len(start)
    at = np.full((n, LENGTH), -1, np.int64)
    i = np.arange(SIDE)
    at[:, :SIDE] = start[:, None] - SIDE + i
    at[:, :SIDE][at[:, :SIDE] < off[row][:, None]] = -1
    at[:, -SIDE:] = end[:, None] + i
    at[:, -SIDE:][at[:, -SIDE:] >= off[row + 1][:, None]] = -1
    size = end - start
    j = np.arange(2 * HALF)
    long = (size > 2 * HALF)[:, None]
    mid = np.where(long & (j >= HALF), end[:, None] - 2 * HALF + j, start[:, None] + j)
    at[:, SIDE:-SIDE] = np.where(long | (j < size[:, None]), mid, -1)
    zone = np.repeat(np.array([0] * SIDE + [1] * (2 * HALF) + [2] * SIDE, np.uint8)[None], n, 0)
    zone[at < 0] = 3
    sym = np.where(at >= 0, _SYM[raw[np.maximum(at, 0)]], 0).astype(np.uint8)
    return sym, zone


def looks(raw: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, begin, end) of all that the network is shown: each candidate, and the windows and runs of long ones."""
    each, size = np.arange(len(start)), end - start
    if not (size > 2 * HALF).any():
        return each, start, end
    more = np.where(size > 2 * HALF, -(-(size - 2 * HALF) // HALF) + 1, 0)
    who = np.repeat(each, more)
    step = np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more)
    at = np.minimum(start[who] + HALF * step, end[who] - 2 * HALF)
    solid = np.concatenate(([0], np.cumsum(ALNUM[raw])))
    ok = solid[at + 2 * HALF] > solid[at]
    who, at = who[ok], at[ok]
    _, x, y = candidates(raw, off, ALNUM)
    of = np.searchsorted(start, x, side="right") - 1  # a run of 16 letters and digits is in a candidate
    ok = size[of] > 2 * HALF
    return np.concatenate((each, who, of[ok])), np.concatenate((start, at, x[ok])), np.concatenate((end, at + 2 * HALF, y[ok]))


@dataclass
class Network:
    """Embedding, one convolution, a maximum over each of the three zones, one hidden layer; then Platt scaling."""

    w: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def new(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return Network({
            "e": r.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32), "c": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32), "cb": np.zeros(FILTERS, np.float32),
            "h": r.normal(0, (2 / (3 * FILTERS)) ** 0.5, (3 * FILTERS, HIDDEN)).astype(np.float32), "hb": np.zeros(HIDDEN, np.float32), "o": r.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32),
        })

    def forward(self, sym: np.ndarray, zone: np.ndarray) -> dict:
        w, n = self.w, len(sym)
        e = w["e"][sym]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, LENGTH - WIDTH + 1, WIDTH * EMBED)
        act = np.maximum(cols @ w["c"] + w["cb"], 0)
        z = zone[:, WIDTH // 2 : LENGTH - WIDTH // 2]
        pool, where = np.zeros((n, 3, FILTERS), np.float32), np.zeros((n, 3, FILTERS), np.int64)
        for k in range(3):
            masked = np.where((z == k)[:, :, None], act, -1.0)
            where[:, k] = masked.argmax(1)
            pool[:, k] = np.maximum(np.take_along_axis(masked, where[:, k][:, None, :], 1)[:, 0], 0)
        flat = pool.reshape(n, -1)
        hid = np.maximum(flat @ w["h"] + w["hb"], 0)
        return {"cols": cols, "pool": pool, "where": where, "flat": flat, "hid": hid, "out": hid @ w["o"] + w["ob"][0]}

    def logits(self, sym: np.ndarray, zone: np.ndarray, step: int = 256) -> np.ndarray:
        return np.concatenate([self.forward(sym[i : i + step], zone[i : i + step])["out"] for i in range(0, len(sym), step)]) if len(sym) else np.zeros(0, np.float32)

    def score(self, sym: np.ndarray, zone: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(sym, zone).astype(np.float64) + self.shift, -40, 40)))

    def gradients(self, sym: np.ndarray, zone: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, w, n = self.forward(sym, zone), self.w, len(sym)
        d = ((1 / (1 + np.exp(-np.clip(f["out"], -40, 40))) - y) / n).astype(np.float32)
        g = {"o": f["hid"].T @ d, "ob": np.array([d.sum()], np.float32)}
        dh = d[:, None] * w["o"] * (f["hid"] > 0)
        g["h"], g["hb"] = f["flat"].T @ dh, dh.sum(0)
        dp = (dh @ w["h"].T).reshape(n, 3, FILTERS) * (f["pool"] > 0)
        g["cb"] = dp.sum((0, 1))
        g["c"], g["e"] = np.zeros_like(w["c"]), np.zeros_like(w["e"])
        i = np.arange(n)
        for k in range(3):
            for c in range(FILTERS):
                at = f["where"][:, k, c]
                g["c"][:, c] += dp[:, k, c] @ f["cols"][i, at]
                back = dp[:, k, c][:, None] * w["c"][:, c][None]
                for t in range(WIDTH):
                    np.add.at(g["e"], sym[i, at + t], back[:, t * EMBED : (t + 1) * EMBED])
        return g


_HEX, _B62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NAMES = ["token", "api_key", "apikey", "secret", "password", "access_key", "client_secret", "auth_token", "private_key", "TOKEN", "SECRET_KEY", "Authorization: Bearer", "bearer", "passwd"]
_PLAIN = ["page", "id", "commit", "see", "file", "path", "url", "item", "word", "title", "class", "ref", "hash", "sha1", "checksum", "order", "isbn", "name", "doi", "at"]


def constructed(rng: random.Random, count: int, words: list[str]) -> list[tuple[bytes, int, int, int]]:
    """(text, begin, end, label) of findings whose label is known because they were made so."""

    def draw(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    def prose(n: int) -> str:
        return " ".join(draw("0123456789", rng.choice([4, 8, 16])) if rng.random() < 0.12 else rng.choice(words) for _ in range(n))

    def long_word() -> str:
        s = ""
        while len(s) < MIN_RUN + rng.randrange(16):
            s += rng.choice(words)
        return s

    out = []
    for i in range(count):
        secret = i % 2 == 0
        if secret:
            kind = rng.randrange(8)
            body = [
                lambda: draw(_HEX, rng.choice([32, 40, 40, 40, 48, 64])), lambda: "AKIA" + draw(_B62[:26] + "234567", 16), lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-"]) + draw(_B62, rng.randrange(20, 40)),
                lambda: draw(_B62 + "+/", rng.choice([24, 32, 40, 44, 64])) + rng.choice(["", "=", "=="]), lambda: "eyJ" + draw(_B62 + "_-", rng.randrange(20, 120)), lambda: draw(_HEX.upper(), rng.choice([32, 40, 64])),
                lambda: draw(_B62 + "_-", rng.randrange(18, 50)), lambda: draw(_HEX, 40),
            ][kind]()
            if kind in (1, 2, 4) and rng.random() < 0.4:
                lead, tail = rng.choice(['"', "'", "", "("]), rng.choice(['"', "'", "", ")", ","])
            else:
                quote = rng.choice(['"', '"', "'", ""])
                lead, tail = rng.choice(_NAMES) + rng.choice([" = ", "=", ": ", " := ", '":']) + quote, quote + rng.choice(["", "", "!!", "###", ";", ","])
        else:
            kind = rng.choice([0, 0, 1, 1, 2, 2, 3, 4, 5, 6])
            body = [
                long_word, long_word, lambda: draw("0123456789", rng.randrange(16, 20)), lambda: "-".join([draw(_HEX, 8), *[draw(_HEX, 4) for _ in range(3)], draw(_HEX, 12)]), lambda: "/".join(rng.choice(words) for _ in range(6)) + "/" + rng.choice(words) * 2,
                lambda: rng.choice("=-_/+") * rng.randrange(16, 70), lambda: "_".join(rng.choice(words) for _ in range(5)) + long_word(),
            ][kind]()
            body = body.upper() if kind < 2 and rng.random() < 0.2 else body.capitalize() if kind < 2 and rng.random() < 0.3 else body
            lead = rng.choice(["", "", rng.choice(_PLAIN) + rng.choice([" ", ": ", "="]), '"', "/", rng.choice(_NAMES) + " " if kind < 2 else ""])
            tail = rng.choice(["", ".", ",", "!!", "/", '"', "***"])
        before, after = (prose(8) + " " + lead).encode(), (tail + " " + prose(8)).encode()
        b = body.encode()
        out.append((before + b + after, len(before), len(before) + len(b), int(secret)))
    return out


_ASSIGNED = re.compile(rb"(?i)(?:token|api_?key|secret|passw(?:or)?d|access_key|bearer|private_key)\W{0,3}[:=]\W{0,3}$")


def by_rule(context: bytes, body: bytes) -> int | None:
    """Label of a candidate of the corpus: 1 if it is assigned to a key's name and mixes letters and digits, 0 if it has
    no digit or nothing else, None where the rule can't tell."""
    digits = sum(48 <= c <= 57 for c in body)
    letters = sum(chr(c).isalpha() for c in body)
    if digits and letters and _ASSIGNED.search(context):
        return 1
    return 0 if not digits or not letters else None


def train(sample: list[bytes], seed: int = 11, constructed_rows: int = 8000, recall: float = 0.995, epochs: int = 7, rule_rows: int = RULE_ROWS) -> Network:
    """The network; ``sample`` are texts of the corpus, of whose candidates ``rule_rows`` at most are labelled by rule. A quarter of the findings is held out for scale and threshold."""
    rng = random.Random(seed)
    words = sorted({w.decode() for t in sample for w in re.findall(rb"[a-z]{2,9}", t)}) or ["alpha", "beta", "gamma", "delta", "river", "stone", "light", "house"]
    rows = constructed(rng, constructed_rows, words)
    own = []
    for t in sample:
        raw = np.frombuffer(t, np.uint8)
        _, a, b = candidates(raw, np.array([0, len(raw)]))
        for x, y in zip(a.tolist(), b.tolist()):
            label = by_rule(t[max(0, x - 40) : x], t[x:y])
            if label is not None:
                own.append((t[max(0, x - 40) : y + 40], x - max(0, x - 40), y - max(0, x - 40), label))
    rng.shuffle(own)
    rows += own[:rule_rows]
    rng.shuffle(rows)
    off = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    sym, zone = windows(raw, off, np.arange(len(rows)), off[:-1] + [r[1] for r in rows], off[:-1] + [r[2] for r in rows])
    y = np.array([r[3] for r in rows], np.float32)
    held = np.arange(len(rows)) % 4 == 3
    net, order = Network.new(), np.flatnonzero(~held)
    m1, m2, t = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    shuffle = np.random.default_rng(seed)
    for epoch in range(epochs):
        shuffle.shuffle(order)
        for i in range(0, len(order), 64):
            at, t = order[i : i + 64], t + 1
            for k, g in net.gradients(sym[at], zone[at], y[at]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - 0.004 * (0.6**epoch) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    z, label = net.logits(sym[held], zone[held]).astype(np.float64), y[held].astype(np.float64)
    for _ in range(300):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -40, 40)))
        net.scale -= 0.1 * float(((p - label) * z).mean()) / max(1.0, float((z * z).mean()))
        net.shift -= 0.5 * float((p - label).mean())
    good = np.sort(net.score(sym[held], zone[held])[label > 0.5])
    net.threshold = min(0.5, float(good[int((1 - recall) * len(good))])) if len(good) else 0.5
    return net


def _sample(docs: DataFrame, text_col: str, sample_docs: int) -> list[bytes]:
    some = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    return [r[0].encode() for r in bounded_sample(some, "text", sample_docs).collect()]


def _scan(arr: pa.Array, net: Network):
    """(row, begin, size, score) of the findings of a block: bytes within the text."""
    for i, j in row_slices(arr):
        raw, off = utf8_parts(arr.slice(i, j - i))
        row, a, b = candidates(raw, off)
        who, x, y = looks(raw, off, a, b)
        p = np.zeros(len(row))
        for k in range(0, len(who), 4096):
            w = who[k : k + 4096]
            np.maximum.at(p, w, net.score(*windows(raw, off, row[w], x[k : k + 4096], y[k : k + 4096])))
        hit = p >= net.threshold
        yield row[hit] + i, a[hit] - off[row[hit]], (b - a)[hit], p[hit]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, recall: float = 0.995) -> DataFrame:
    """(doc_id, byte_start, byte_length, score) of every finding in every row; places are bytes of the UTF-8 text.

    Null and empty texts have none, texts of any length are scanned whole, and an empty table gives no row. Rows that
    repeat are scanned each; a null doc_id is carried. For training, words and rule-labelled findings come from
    ``sample_docs`` texts of at most SAMPLE_TEXT_BYTES.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(_sample(docs, text_col, sample_docs), recall=recall))  # some KB

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for row, at, size, p in _scan(b.column(1), net.value):
                if len(row):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(at), pa.array(size), pa.array(np.round(p, 6))], names=["doc_id", "byte_start", "byte_length", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, byte_start bigint, byte_length bigint, score double")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]", sample_docs: int = SAMPLE_DOCS, recall: float = 0.995) -> DataFrame:
    """``docs``, all rows and columns, with each finding replaced by ``mark`` and ``size_col`` (if there) set to the new length
    where the text changed. Null and empty texts stay as they are, rows that repeat are masked each, texts of any length
    whole; an empty table stays empty. ``sample_docs`` as in findings."""
    net = docs.sparkSession.sparkContext.broadcast(train(_sample(docs, text_col, sample_docs), recall=recall))

    @F.arrow_udf("string")
    def masked(arr: pa.Array) -> pa.Array:
        cuts: dict[int, list] = {}
        for row, at, size, _ in _scan(arr, net.value):
            for r, a, n in zip(row.tolist(), at.tolist(), size.tolist()):
                cuts.setdefault(r, []).append((a, n))
        out: list[str | None] = [None] * len(arr)
        for r, spans in cuts.items():
            t, last, parts = arr[r].as_py().encode(), 0, []
            for a, n in spans:
                parts += [t[last:a], mark.encode()]
                last = a + n
            out[r] = b"".join([*parts, t[last:]]).decode()
        return pa.array(out, pa.string())

    (m,) = fresh(docs.columns, "masked_text")
    out = docs.withColumn(m, masked(F.col(text_col).cast("string")))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.coalesce(m, text_col).alias(c))
        elif c == size_col:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col(m).isNotNull(), F.length(m).cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)
