"""Operator 4: secrets, by a character convolutional network over every candidate and its context.

Candidates are ASCII runs of at least RUN letters, digits, +, /, _ and - that hold a letter and a digit (`run`), values
of six or more characters assigned to a name such as token or password (`assigned`), and private
key blocks from the header to the end line, or to the last line of base64 where there is none (`block`). Each is read with BEFORE bytes before and AFTER bytes after it, in
windows that move on over a long one, of which the most suspect counts.

The network (byte embedding, two convolutions, maxima over the window, one output) is trained here in
numpy on labelled findings. Its scores are calibrated by Platt's method on findings it has not seen, and for
each kind the threshold is the largest with which a share of RECALL of the held-out secrets is found.

Labelled findings are rows (before, value, after, label). Those of `labelled` put public formats of keys, and
look-alikes that are no secrets (digests, identifiers, paths, placeholders), into context from a bounded sample of
SAMPLE documents, of least hash; FINDINGS of them.

Null and empty texts have no candidate; repeated rows have theirs each; ties of overlapping candidates go to the
assigned one; an empty table gives an empty one. Extra columns are ignored, in `redact` passed through; there n_chars,
if it is a column, becomes the new length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import lean, texts

RUN, LONGEST_KEY = 16, 40
BEFORE, VALUE, AFTER, STRIDE = 32, 72, 8, 48
WINDOW = BEFORE + VALUE + AFTER
#: Bounds of training: documents that give context, labelled findings, passes over them.
SAMPLE, FINDINGS, EPOCHS = 200, 2_500, 6
RECALL = 0.99
KINDS = ("run", "assigned", "block")
MASK = "[SECRET]"

FOUND = "doc_id long, start int, length int, kind string, value_sha256 string, probability double, secret boolean"

_RUN = np.zeros(256, bool)
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = True
_RUN[[ord(c) for c in "+/_-"]] = True
_NAME = re.compile(rb"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)[\"']?\s{0,2}$", re.I)
_VALUE = re.compile(rb"\s{0,2}[\"'`]?([^\s\"'`<>,;]{6,})")
_BLOCK = re.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(rb"-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a key without an end, and what is between its header and its end: armour headers, then lines of base64; line ends may be written as escapes.
_LINES = re.compile(rb"(?:(?:\\[rn]|\s){1,4}[A-Za-z0-9+/=]{16,})*(?:(?:\\[rn]|\s){1,4}[A-Za-z0-9+/]{1,15}={1,2})?")
_BODY = re.compile(rb"(?:(?:\\[rn]|\s)*[A-Za-z-]{1,30}: [^\r\n\\]{0,80})*(?:(?:\\[rn]|\s)*[A-Za-z0-9+/=]{1,4096})*(?:\\[rn]|\s)*")


def _block_end(data: bytes, header: int, row: int) -> int:
    """Where a private key whose header ends at `header` ends, in a text that ends at `row`: after its end line, or its last line of base64."""
    m = _END.search(data, header, row)
    if m:
        body = data[header : m.start()]
        # Prose matches as well, but has few long stretches.
        if _BODY.fullmatch(body) and sum(len(x) for x in re.findall(rb"[A-Za-z0-9+/=]{16,}", body)) >= 0.5 * len(body.strip()):
            return m.end()
    return _LINES.match(data, header, row).end()


def candidates(raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) of all candidates, in bytes of raw, in order."""
    n = len(raw)
    if not n:
        return []
    ok = _RUN[raw]
    row_start = np.zeros(n + 1, bool)
    row_start[off] = True
    edge = np.flatnonzero(np.diff(np.r_[False, ok, False]))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= RUN
    begin, end = begin[long], end[long]
    spans: dict[tuple[int, int], int] = {}
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        inner = [a, *(np.flatnonzero(row_start[a + 1 : b]) + a + 1).tolist(), b]
        for x, y in zip(inner, inner[1:], strict=False):
            value = raw[x:y]
            if y - x >= RUN and ((value >= 48) & (value < 58)).any() and (value > 64).any():
                while y < n and raw[y] == 61 and not row_start[y]:
                    y += 1
                spans[x, y] = 0
    data = raw.tobytes()
    assigned = []
    for p in np.flatnonzero((raw == 61) | (raw == 58)).tolist():
        r = int(np.searchsorted(off, p, side="right")) - 1
        if _NAME.search(data, max(int(off[r]), p - LONGEST_KEY), p):
            m = _VALUE.match(data, p + 1, int(off[r + 1]))
            if m:
                assigned.append(m.span(1))
    blocks: list[tuple[int, int]] = []
    for m in _BLOCK.finditer(data):
        r = int(np.searchsorted(off, m.start(), side="right")) - 1
        if m.end() <= off[r + 1]:
            blocks.append((m.start(), _block_end(data, m.end(), int(off[r + 1]))))
    if blocks:
        # What is within a key is part of it.
        within = lambda a, b: any(x <= a and b <= y for x, y in blocks)
        spans = {x: k for x, k in spans.items() if not within(*x)} | {x: 2 for x in blocks}
        assigned = [x for x in assigned if not within(*x)]
    out = [(a, b, k) for (a, b), k in spans.items() if not any(a < y and x < b for x, y in assigned)] if assigned else [(a, b, k) for (a, b), k in spans.items()]
    out += [(a, b, 1) for a, b in sorted(set(assigned))]
    return [(int(np.searchsorted(off, a, side="right")) - 1, a, b, k) for a, b, k in sorted(out)]


def windows(data: bytes, low: int, high: int, start: int, end: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Windows over data[low:high] for the candidate start..end, and where the candidate lies in each."""
    out, where = [], []
    at = start
    while True:
        a, b = at - BEFORE, at + VALUE + AFTER
        part = data[max(a, low) : min(b, high)]
        left = max(0, low - a)
        out.append((b"\0" * left + part).ljust(WINDOW, b"\0"))
        where.append((max(0, start - a), min(WINDOW, end - a)))
        if at + VALUE >= end:
            return out, where
        at += STRIDE


def _inputs(rows: list[bytes], where: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)
    col = np.arange(WINDOW)
    span = np.array(where).reshape(-1, 2)
    return x, ((col >= span[:, :1]) & (col < span[:, 1:])).astype(np.float32)


class Net:
    """The network. Parameters are numpy arrays; a pass over n windows keeps n x WINDOW x channels floats."""

    E, C1, K1, C2, K2 = 8, 16, 5, 24, 3

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        g = lambda *shape: (r.standard_normal(shape) * np.sqrt(2 / np.prod(shape[:-1]))).astype(np.float32)
        self.p = {"e": (r.standard_normal((256, self.E)) * 0.3).astype(np.float32), "w1": g(self.K1 * (self.E + 1), self.C1), "b1": np.zeros(self.C1, np.float32), "w2": g(self.K2 * self.C1, self.C2), "b2": np.zeros(self.C2, np.float32), "w3": g(2 * self.C2, 1), "b3": np.zeros(1, np.float32)}

    @staticmethod
    def _patches(x: np.ndarray, k: int) -> np.ndarray:
        pad = np.pad(x, ((0, 0), (k // 2, k // 2), (0, 0)))
        return np.concatenate([pad[:, i : i + x.shape[1]] for i in range(k)], axis=2)

    @staticmethod
    def _unpatch(g: np.ndarray, k: int, c: int) -> np.ndarray:
        n, w, _ = g.shape
        out = np.zeros((n, w + k - 1, c), np.float32)
        for i in range(k):
            out[:, i : i + w] += g[:, :, i * c : (i + 1) * c]
        return out[:, k // 2 : k // 2 + w]

    def forward(self, x: np.ndarray, flag: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        a0 = np.concatenate([p["e"][x], flag[:, :, None]], axis=2)
        c1 = self._patches(a0, self.K1)
        a1 = np.maximum(c1 @ p["w1"] + p["b1"], 0)
        c2 = self._patches(a1, self.K2)
        a2 = np.maximum(c2 @ p["w2"] + p["b2"], 0)
        inside = a2 * flag[:, :, None]
        top, mean = inside.argmax(axis=1), inside.sum(axis=1) / np.maximum(1, flag.sum(axis=1))[:, None]
        h = np.concatenate([np.take_along_axis(inside, top[:, None], 1)[:, 0], mean], axis=1)
        if keep is not None:
            keep.update(a0=a0, c1=c1, a1=a1, c2=c2, a2=a2, top=top, h=h)
        return (h @ p["w3"])[:, 0] + p["b3"][0]

    def step(self, x: np.ndarray, flag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        k: dict = {}
        z = self.forward(x, flag, k)
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"w3": k["h"].T @ d[:, None], "b3": d.sum(keepdims=True)}
        dh = d[:, None] * self.p["w3"][:, 0]
        d2 = dh[:, None, self.C2 :] * (flag / np.maximum(1, flag.sum(axis=1))[:, None])[:, :, None]
        np.put_along_axis(d2, k["top"][:, None], np.take_along_axis(d2, k["top"][:, None], 1) + dh[:, None, : self.C2], 1)
        d2 *= (k["a2"] > 0) & (flag[:, :, None] > 0)
        g["w2"], g["b2"] = np.tensordot(k["c2"], d2, ((0, 1), (0, 1))), d2.sum(axis=(0, 1))
        d1 = self._unpatch(d2 @ self.p["w2"].T, self.K2, self.C1) * (k["a1"] > 0)
        g["w1"], g["b1"] = np.tensordot(k["c1"], d1, ((0, 1), (0, 1))), d1.sum(axis=(0, 1))
        d0 = self._unpatch(d1 @ self.p["w1"].T, self.K1, self.E + 1)[:, :, : self.E]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x.ravel(), d0.reshape(-1, self.E))
        return g


@dataclass
class Model:
    net: Net
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def probability(self, x: np.ndarray, flag: np.ndarray) -> np.ndarray:
        z = [self.net.forward(x[i : i + 512], flag[i : i + 512]) for i in range(0, len(x), 512)]
        return 1 / (1 + np.exp(-(self.slope * np.concatenate(z).astype(np.float64) + self.shift))) if z else np.zeros(0)


Finding = tuple[str, str, str, int]


def _kind(before: bytes, value: bytes) -> int:
    m = re.search(rb"[=:]\s{0,2}[\"'`]?$", before)
    return 2 if _BLOCK.match(value) else 1 if m and _NAME.search(before[: m.start()]) else 0


def train(rows: list[Finding], epochs: int = EPOCHS, recall: float = RECALL, seed: int = 5) -> Model:
    """Network, calibration and thresholds. Every fifth finding is held out for the latter two; without secrets held out of a kind its threshold is that of all kinds together."""
    data, where, label, kind = [], [], [], []
    for before, value, after, y in rows:
        b, v = before.encode(), value.encode()
        text = b + v + after.encode()
        w, at = windows(text, 0, len(text), len(b), len(b) + len(v))
        # A long value is learned by its first window.
        data.append(w[0])
        where.append(at[0])
        label.append(y)
        kind.append(_kind(b, v))
    x, flag = _inputs(data, where)
    y, kinds = np.array(label, np.float32), np.array(kind)
    held = np.arange(len(y)) % 5 == 4
    net, r = Net(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    t, fit = 0, np.flatnonzero(~held)
    for epoch in range(epochs):
        r.shuffle(fit)
        rate = 4e-3 * (1 - epoch / epochs) + 5e-4
        for i in range(0, len(fit), 64):
            j = fit[i : i + 64]
            g = net.step(x[j], flag[j], y[j])
            t += 1
            for k in g:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model = Model(net, 1.0, 0.0, (0.5,) * len(KINDS))
    if not held.any():
        return model
    z = np.concatenate([net.forward(x[j : j + 512], flag[j : j + 512]) for j in range(0, len(x), 512)]).astype(np.float64)[held]
    # Platt's targets, fitted by Newton's method with a little ridge.
    pos, neg = float(y[held].sum()), float((1 - y[held]).sum())
    target = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    f = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(f @ ab, -30, 30)))
        h = (f * (q * (1 - q))[:, None]).T @ f + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, f.T @ (q - target) + 1e-3 * (ab - [1.0, 0.0])), -1, 1)
    model.slope, model.shift = float(ab[0]), float(ab[1])
    q = 1 / (1 + np.exp(-(f @ ab)))

    def least(of: np.ndarray) -> float:
        s = np.sort(q[of & (y[held] > 0)])
        return min(0.5, float(s[int(np.floor((1 - recall) * len(s)))])) if len(s) else 0.5

    everything = np.ones(len(q), bool)
    model.thresholds = tuple(least(kinds[held] == k if (y[held][kinds[held] == k] > 0).any() else everything) for k in range(len(KINDS)))
    return model


def labelled(context: list[str], n: int = FINDINGS, seed: int = 9) -> list[Finding]:
    """Findings of public key formats, and look-alikes, in the given texts' words."""
    r = np.random.default_rng(seed)
    words = [w for t in context for w in t.split()] or "the of and to in is that for it was".split()
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    hexa = lambda k: pick("0123456789abcdef", k)
    alnum = low + up + digit
    word = lambda: words[int(r.integers(0, len(words)))]
    one = lambda xs: xs[int(r.integers(0, len(xs)))]
    text = lambda k: " ".join(word() for _ in range(k))

    def secret() -> tuple[str, str, str]:
        c = int(r.integers(0, 12))
        if c == 0:
            return "", one(["AKIA", "ASIA"]) + pick(up + "234567", 16), ""
        if c == 1:
            return "", "AKIA" + pick(up + digit, 16), ""
        if c == 2:
            return "", one(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36), ""
        if c == 3:
            return "", "xoxb-" + pick(digit, 12) + "-" + pick(alnum, 24), ""
        if c == 4:
            return "", one(["sk_live_", "rk_live_"]) + pick(alnum, 24), ""
        if c == 5:
            return "", "AIza" + pick(alnum + "-_", 35), ""
        if c == 6:
            return "", "eyJ" + pick(alnum + "_-", int(r.integers(30, 120))), ""
        if c == 7:
            return f"-----BEGIN {one(['RSA ', 'EC ', ''])}PRIVATE KEY-----", "", ""
        name = one(["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "client_secret", "credential"])
        name = one([name, name.upper(), name.capitalize(), word() + "_" + name])
        sep, quote = one(["=", " = ", ": ", ":", "= "]), one(["", '"', "'"])
        value = one([hexa, lambda k: pick(alnum, k), lambda k: pick(alnum + "+/", k), lambda k: pick(alnum + "!@#$%^&*", k)])(int(one([8, 10, 12, 16, 18, 20, 24, 32, 40, 48, 64])))
        return name + sep + quote, value, quote

    def other() -> tuple[str, str, str]:
        c = int(r.integers(0, 12))
        if c == 0:
            return one(["commit ", "rev ", "sha1 ", "blob ", "hash "]), hexa(40), ""
        if c == 1:
            return one(["md5: ", "sha256: ", "checksum ", "etag ", "digest: "]), hexa(int(one([32, 64]))), ""
        if c == 2:
            return one(["id ", "uuid ", "request ", ""]), "-".join(hexa(k) for k in (8, 4, 4, 4, 12)), ""
        if c == 3:
            return one(["https://example.com/", "/var/lib/", "see "]), "/".join([word() + pick(digit, 2), word(), pick(digit, 4), word()]), ""
        if c == 4:
            return "data:image/png;base64,", "iVBORw0KGgo" + pick(alnum + "+/", 40), ""
        if c == 5:
            return one(["order ", "invoice ", "no. ", ""]), pick(up, 2) + "-" + pick(digit, 4) + "-" + pick(digit, 8), ""
        if c == 6:
            return "", word() + word() + word() + pick(digit, int(r.integers(1, 5))), ""
        if c == 7:
            return one(["isbn ", "doi ", "ref "]), "978-" + pick(digit, 1) + "-" + pick(digit, 4) + "-" + pick(digit, 4) + "-" + pick(digit, 1), ""
        if c == 8:
            return "", word() + "-" + pick(digit, 4) + "-" + word() + "-" + word() + "_v" + pick(digit, 1), ""
        if c == 9:
            return one(["password: ", "token = ", "secret=", "api_key: "]), one(["changeme", "example", "your-token-here", "<redacted>", "********", "xxxxxxxxxxxx", "placeholder", "required", "undefined", "process.env.TOKEN"]), ""
        if c == 10:
            return one(["the token: ", "auth: ", "the secret: ", "password: "]), one([word() + word(), word() + word() + word()]) or "nothing", " " + word()
        return one(["tel ", "card ", ""]), pick(digit, 4) + "-" + pick(digit, 4) + "-" + pick(digit, 4) + "-" + one([pick(digit, 4), pick(digit, 3) + "x"]), ""

    out: list[Finding] = []
    for i in range(n):
        y = i % 2
        before, value, after = secret() if y else other()
        if not value:
            before, value = "", before
        out.append((text(8) + one([" ", "\n", " "]) + before, value, after + one([" ", ".", ", ", "\n", ""]) + text(4), y))
    # Labels stand in an order that the held-out fifth shares.
    return [out[i] for i in r.permutation(len(out))]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Model with context from at most `sample` documents, of least hash."""
    # Chosen by hash alone, so that no task sends texts that others beat.
    key = F.xxhash64("doc_id", "text")
    some = texts(docs).where(F.length("text").between(50, 20_000)).withColumn("h", key)
    chosen = sorted({r.h for r in some.select("h").orderBy("h").limit(sample).collect()})
    few = some.where(F.col("h").isin(chosen)).select("text").distinct()
    return train(labelled(sorted(r.text for r in few.select("text").collect())))


def judge(model: Model, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, float, bool]]:
    """(row, start, end, kind, probability, secret) of each candidate, in bytes of raw."""
    found = candidates(raw, off)
    if not found:
        return []
    data = raw.tobytes()
    rows, where, owner = [], [], []
    for k, (r, a, b, _) in enumerate(found):
        w, at = windows(data, int(off[r]), int(off[r + 1]), a, b)
        rows += w
        where += at
        owner += [k] * len(w)
    best = np.zeros(len(found))
    np.maximum.at(best, np.array(owner), model.probability(*_inputs(rows, where)))
    return [(r, a, b, k, float(q), bool(q >= model.thresholds[k])) for (r, a, b, k), q in zip(found, best, strict=True)]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """FOUND: every candidate with its place in characters, the SHA-256 of its value, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw_all, off_all = tv.strings(batch.column(1))
            for lo, hi in tv.slices(off_all):
                raw, off = raw_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                out = []
                for r, a, b, k, q, secret in judge(model, raw, off):
                    value = raw[a:b].tobytes()
                    chars = lambda x, y: int(((raw[x:y] & 0xC0) != 0x80).sum())  # noqa: E731, B023
                    out.append({"doc_id": int(ids[lo + r]), "start": chars(off[r], a), "length": chars(a, b), "kind": KINDS[k], "value_sha256": hashlib.sha256(value).hexdigest(), "probability": q, "secret": secret})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("value_sha256", pa.string()), ("probability", pa.float64()), ("secret", pa.bool_())]))

    return texts(docs).mapInArrow(lean(run), FOUND)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """All documents with all their columns, secrets replaced by MASK in the text."""
    place = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(place)
            raw_all, off_all = tv.strings(col)
            new: dict[int, bytes] = {}
            for lo, hi in tv.slices(off_all):
                raw, off = raw_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                spans: dict[int, list[tuple[int, int]]] = {}
                for r, a, b, _, _, secret in judge(model, raw, off):
                    if secret:
                        spans.setdefault(r, []).append((a, b))
                for r, parts in spans.items():
                    out, at = [], int(off[r])
                    for a, b in parts:
                        out += [raw[at:a].tobytes(), MASK.encode()]
                        at = b
                    new[lo + r] = b"".join(out) + raw[at : off[r + 1]].tobytes()
            if not new:
                yield batch
                continue
            where = np.zeros(batch.num_rows, bool)
            where[list(new)] = True
            texts_ = [new[k].decode() for k in sorted(new)]
            arrays = list(batch.columns)
            arrays[place] = pa.compute.replace_with_mask(col, pa.array(where), pa.array(texts_, col.type))
            if size is not None:
                arrays[size] = pa.compute.replace_with_mask(batch.column(size), pa.array(where), pa.array([len(t) for t in texts_], batch.column(size).type))
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)
