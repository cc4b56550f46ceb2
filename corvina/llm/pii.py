"""Personal data: base patterns, and spans found by a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on the driver from labelled spans: windows of a bounded sample of the documents
(``sample_rows``) labelled by the base patterns' shapes, and the same texts with spans written into them in the forms
that the base patterns know and in others (grouped national numbers, dotted or defanged addresses, spaced mail
addresses), beside dates, versions, prices and codes that are none. It labels windows of LENGTH characters that overlap
by half. Every kind of span holds a digit, an at sign, or an "at" spelled in brackets or with a spelled "dot" behind it, so
windows lie wherever one of these is near; all other places are "none" without running the network, as no span could be
proved there. Overlapping windows are reconciled over the whole text: each character
takes the label of the window in whose middle it lies most, and spans are read from the joined labels, across window
bounds. A span counts if an exact check of its kind holds (digits, Luhn sum, parts at most 255, the mail pattern
without blanks and brackets), it stands free of letters and digits, and it overlaps no base span.

Spans are kind:start:end in code points, end exclusive, by start, then kind in the order of KINDS, then end. Null texts
count as empty and have no spans. Rows are judged each for itself, repeated rows and rows that share a doc_id too. A
carried column that has the name of an added one comes as ``<name>_given``. All base patterns run in linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LENGTH, STRIDE, AROUND = 64, 32, 24
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What every kind of span holds: a digit, an at sign, or a spelled "at" in brackets or before a spelled "dot".
CUES = re.compile(r"(?:[0-9@]|[\[(]\s?at\s?[\])]|\sat\s+[A-Za-z0-9-]{1,40}\s+dot\s)(?:.{0,23}[0-9@])*+", re.DOTALL)
CUE = re.compile(r"[0-9@]")
#: Spelled marks of a mail address.
SPELLED_AT = re.compile(r"\s*[\[(]\s?(?:at|@)\s?[\])]\s*|\s+at\s+")
SPELLED_DOT = re.compile(r"\s*[\[(]\s?(?:dot|\.)\s?[\])]\s*|\s+dot\s+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def with_luhn(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, found from the at signs outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def shapes(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, before their checks."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if CUE.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text)] if "." in text else []
        out += [("card", *m.span()) for m in CARD.finditer(text)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text)] if "+" in text else []
    return out


def holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    if kind == "card":
        digits = only_digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(only_digits(found)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return in_order([s for s in shapes(text) if holds(s[0], text[s[1] : s[2]])])


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda x: (x[1], ORDER[x[0]], x[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# --- the network


def char_ids(text: str) -> np.ndarray:
    """ASCII as it is; other letters 1, other blanks 2, anything else 3."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.array([ord(c) if c < "\x80" else 1 if c.isalpha() else 2 if c.isspace() else 3 for c in text], np.uint8)


@dataclass
class Model:
    embed: np.ndarray  # 128 x dim
    wx: list[np.ndarray]  # for each direction: dim x 4 hidden
    wh: list[np.ndarray]  # hidden x 4 hidden
    b: list[np.ndarray]
    out: np.ndarray  # 2 hidden x labels
    ob: np.ndarray
    trans: np.ndarray  # from x to
    begin: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.wx, *self.wh, *self.b, self.out, self.ob, self.trans, self.begin]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_model(dim: int = 12, hidden: int = 20, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    f32 = np.float32
    bias = np.zeros(4 * hidden, f32)
    bias[hidden : 2 * hidden] = 1  # the forget gates start open
    return Model(rng.normal(0, 0.3, (128, dim)).astype(f32), [rng.normal(0, 0.25, (dim, 4 * hidden)).astype(f32) for _ in "fb"], [rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(f32) for _ in "fb"], [bias.copy() for _ in "fb"], rng.normal(0, 0.2, (2 * hidden, LABELS)).astype(f32), np.zeros(LABELS, f32), np.zeros((LABELS, LABELS), f32), np.zeros(LABELS, f32))


def lstm(table: np.ndarray, wh: np.ndarray, x: np.ndarray, keep: bool = False):
    """Hidden states (L x B x H) over ids x (B x L); with ``keep`` what the way back needs."""
    n, length = x.shape
    hidden = wh.shape[0]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    states, kept = np.empty((length, n, hidden), np.float32), []
    for t in range(length):
        z = table[x[:, t]] + h @ wh
        gates = sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        states[t] = h
    return states, kept


def emissions(m: Model, x: np.ndarray) -> np.ndarray:
    """L x B x labels."""
    forward, _ = lstm(m.embed @ m.wx[0] + m.b[0], m.wh[0], x)
    backward, _ = lstm(m.embed @ m.wx[1] + m.b[1], m.wh[1], x[:, ::-1])
    hidden = m.wh[0].shape[0]
    return forward @ m.out[:hidden] + backward[::-1] @ m.out[hidden:] + m.ob


def decode(m: Model, x: np.ndarray) -> np.ndarray:
    """Best label paths (B x L) by Viterbi."""
    e = emissions(m, x)
    length, n, _ = e.shape
    back = np.empty((length, n, LABELS), np.int8)
    score = e[0] + m.begin
    for t in range(1, length):
        steps = score[:, :, None] + m.trans[None]
        back[t] = steps.argmax(axis=1)
        score = steps.max(axis=1) + e[t]
    out = np.empty((n, length), np.int8)
    out[:, -1] = score.argmax(axis=1)
    rows = np.arange(n)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t, rows, out[:, t]]
    return out


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log likelihood of the label paths y (B x L), by forward and backward sums and BPTT."""
    n, length = x.shape
    hidden = m.wh[0].shape[0]
    xs = [x, x[:, ::-1]]
    runs = [lstm(m.embed @ m.wx[d] + m.b[d], m.wh[d], xs[d], True) for d in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=2)
    e = both @ m.out + m.ob
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + m.begin
    for t in range(1, length):
        alpha[t] = logsumexp(alpha[t - 1][:, :, None] + m.trans[None], 1) + e[t]
    for t in range(length - 2, -1, -1):
        beta[t] = logsumexp(m.trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = logsumexp(alpha[-1], 1)
    marginal = np.exp(alpha + beta - z[None, :, None])
    d_trans = np.zeros_like(m.trans)
    for t in range(length - 1):
        d_trans += np.exp(alpha[t][:, :, None] + m.trans[None] + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(d_trans, (y[:, t], y[:, t + 1]), -1)
    d_e = marginal
    d_e[np.arange(length)[:, None], np.arange(n)[None, :], y.T] -= 1
    d_begin = d_e[0].sum(0)
    d_out = both.reshape(-1, 2 * hidden).T @ d_e.reshape(-1, LABELS)
    d_both = d_e @ m.out.T
    d_embed, d_wx, d_wh, d_b = np.zeros_like(m.embed), [], [], []
    for d in (0, 1):
        d_h = d_both[:, :, :hidden] if d == 0 else d_both[::-1, :, hidden:]
        kept, wh = runs[d][1], m.wh[d]
        d_table = np.zeros((len(m.embed), 4 * hidden), np.float32)
        g_wh = np.zeros_like(wh)
        after_h, after_c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        for t in range(length - 1, -1, -1):
            h, before, i, f, o, g, tc = kept[t]
            dh = d_h[t] + after_h
            dc = after_c + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            g_wh += h.T @ dz
            np.add.at(d_table, xs[d][:, t], dz)
            after_h, after_c = dz @ wh.T, dc * f
        d_wx.append(m.embed.T @ d_table)
        d_embed += d_table @ m.wx[d].T
        d_wh.append(g_wh)
        d_b.append(d_table.sum(0))
    return [g / n for g in [d_embed, *d_wx, *d_wh, *d_b, d_out, d_e.sum((0, 1)), d_trans, d_begin]]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 350, rate: float = 0.02, seed: int = 11) -> Model:
    m, rng = new_model(seed=seed), np.random.default_rng(seed)
    params = m.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        batch = rng.integers(0, len(x), 64)
        grads = gradients(m, x[batch], y[batch])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        lr = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, a, v in zip(params, grads, first, second):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            p -= (lr * a / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return m


# --- labelled spans


def written_spans(rng: np.random.Generator) -> tuple[str, str]:
    """(kind, text) of a made-up span, or ("", text) of something that is none."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    pick = lambda *x: x[rng.integers(0, len(x))]
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    what = rng.integers(0, 10)
    if what == 0:
        name, host = pick(word(), f"{word()}.{word()}", f"{word()}{d(2)}"), f"{word()}{pick('', d(1))}.{pick('', 'example.')}{pick('com', 'net', 'org', 'de')}"
        spelled = host.replace(".", " dot ")
        return "email", pick(f"{name}@{host}", f"{name} @ {host}", f"{name}[@]{host}", f"{name}@ {host}", f"{name} @{host}", f"{name} at {spelled}", f"{name} [at] {host}", f"{name}(at){host}", f"{name} (at) {spelled}", f"{name}[at]{host.replace('.', '[dot]')}")
    if what in (1, 2):
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return "ip", pick(".", ".", "[.]", " . ", "(.)").join(parts)
    if what in (3, 4):
        n = pick(16, 16, 15)
        number = with_luhn(d(n - 1))
        groups = [number[i : i + 4] for i in range(0, n, 4)]
        return "card", pick(number, " ".join(groups), "-".join(groups), ".".join(groups), "/".join(groups), "  ".join(groups), "_".join(groups))
    if what in (5, 6):
        a, b, c = d(3), d(3), d(4)
        return "phone", pick(f"+1 ({a}) {b}-{c}", f"+{d(2)} {d(3)} {d(6)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{d(2)} {a} {b} {c}", f"+{d(2)}/{a}/{d(6)}", f"1-{a}-{b}-{c}", f"0{d(2)}/{d(7)}")
    none = [f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"Version {d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)}.{d(2)}", f"id {d(int(rng.integers(1, 9)))}", "".join(pick(*"0123456789abcdef") for _ in range(int(rng.integers(20, 41)))), f"@{word()}", f"19{d(2)}-20{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(int(rng.integers(1, 8))), f"#{d(5)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{word()}{d(3)}"]
    return "", pick(*none)


def labelled(carriers: list[str], windows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of carriers with their own spans, and with made-up ones written between their words."""
    rng = np.random.default_rng(seed)
    carriers = [c for c in carriers if c] or ["text"]
    xs, ys = [], []
    for k in range(windows):
        text = carriers[int(rng.integers(0, len(carriers)))]
        if k % 4 == 0 and (cues := list(CUE.finditer(text))):
            middle = cues[int(rng.integers(0, len(cues)))].start()
            start = max(0, middle - int(rng.integers(0, LENGTH)))
            spans = base_spans(text)
        else:
            words = text[(at := int(rng.integers(0, len(text)))) : at + 200].split() or [""]
            words = [w for w in words if not CUE.search(w)] or [""]
            parts, spans, size = [], [], 0
            for w in words:
                if rng.random() < 0.2:
                    kind, made = written_spans(rng)
                    if kind:
                        spans.append((kind, size, size + len(made)))
                    made += ("", "", "", ".", ",", ")", ";")[int(rng.integers(0, 7))]
                    parts.append(made)
                    size += len(made) + 1
                parts.append(w)
                size += len(w) + 1
            text = " ".join(parts)
            start = int(rng.integers(0, max(1, len(text) - LENGTH // 2)))
        x, y = np.zeros(LENGTH, np.uint8), np.zeros(LENGTH, np.int64)
        part = text[start : start + LENGTH]
        x[: len(part)] = char_ids(part)
        for kind, s, e in spans:
            s, e, label = s - start, e - start, 1 + 2 * ORDER[kind]
            for i in range(max(0, s), min(LENGTH, e)):
                if y[i] == 0:
                    y[i] = label if i == s else label + 1
        xs.append(x)
        ys.append(y)
    return np.stack(xs), np.stack(ys)


def train(docs: DataFrame, sample_rows: int = 400, chars: int = 2000, windows: int = 6000, seed: int = 11) -> Model:
    """A network from about ``sample_rows`` documents, chosen by a hash of doc_id over the whole table; of each, ``chars``
    characters around its first cue serve as carrier for training."""
    total = docs.count()
    share = int((1 << 20) * min(1.0, sample_rows / max(1, total)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share).where("text is not null")
    cue = F.greatest(F.lit(1), F.regexp_instr("text", F.lit("[0-9@]")) - chars // 2)
    rows = sorted((str(r["doc_id"]), r["part"]) for r in chosen.select("doc_id", F.col("text").substr(cue.cast("int"), F.lit(chars)).alias("part")).toLocalIterator())
    return fit(*labelled([p for _, p in rows], windows, seed), seed=seed)


# --- spans of whole texts


def placed_windows(text: str) -> list[tuple[int, int]]:
    """(start, end of its region) of each window; regions are the surroundings of digits and at signs, and cut no run of
    mail characters."""
    out, last = [], 0
    for m in CUES.finditer(text):
        start, end = max(last, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if end <= last:
            continue
        while last < start and text[start] in LOCAL and text[start - 1] in LOCAL:
            start -= 1
        while end < len(text) and text[end - 1] in LOCAL and text[end] in LOCAL:
            end += 1
        at = start
        while True:
            out.append((at, end))
            if at + LENGTH >= end:
                break
            at += STRIDE
        last = end - AROUND if end < len(text) else end
    return out


def reconciled(starts: list[int], labels: np.ndarray, size: int) -> dict[int, int]:
    """Label of each character that a window covers: of the window in whose middle it lies most."""
    best: dict[int, tuple[int, int]] = {}
    for start, row in zip(starts, labels.tolist()):
        for i, label in enumerate(row):
            at = start + i
            if at >= size:
                break
            depth = min(i, LENGTH - 1 - i)
            if at not in best or depth > best[at][0]:
                best[at] = (depth, label)
    return {at: label for at, (_, label) in best.items() if label}


def spans_of(labels: dict[int, int]) -> list[tuple[str, int, int]]:
    out: list[list] = []
    for at in sorted(labels):
        kind, begins = KINDS[(labels[at] - 1) // 2], labels[at] % 2 == 1
        if out and out[-1][2] == at and out[-1][0] == kind and not begins:
            out[-1][2] = at + 1
        else:
            out.append([kind, at, at + 1])
    return [tuple(x) for x in out]


def unspelled(found: str) -> str:
    """With marks for a spelled "at" and "dot". A bare "at" only counts where a "dot" is spelled too."""
    bracketed = re.search(r"\sat\s", found) is None
    return SPELLED_DOT.sub(".", SPELLED_AT.sub("@", found)) if bracketed or SPELLED_DOT.search(found) else found


def proved(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The span without outer blanks and marks if the exact check of its kind holds."""
    lead = "+(" if kind == "phone" else ""
    while start < end and not (text[start].isalnum() or text[start] in lead):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    found = text[start:end]
    if not found or (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None
    if kind == "email":
        ok = EMAIL.fullmatch(re.sub(r"[\s\[\]()]", "", unspelled(found))) is not None
    elif kind == "ip":
        ok = re.fullmatch(r"[0-9]{1,3}(?:[\s\[\](.)]{1,3}[0-9]{1,3}){3}", found) is not None and all(int(p) <= 255 for p in re.findall(r"[0-9]+", found)) and found.count(".") == 3
    elif kind == "card":
        ok = re.fullmatch(r"[0-9](?:[^\w]{0,2}_?[0-9])+", found) is not None and holds("card", found)
    else:
        ok = re.fullmatch(r"\+?\(?[0-9](?:[\s().\-/]{0,2}[0-9])+", found) is not None and holds("phone", found) and not found.isdigit()
    return (kind, start, end) if ok else None


def added_spans(text: str, base: list[tuple[str, int, int]], starts: list[int], labels: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for kind, s, e in spans_of(reconciled(starts, labels, len(text))):
        got = proved(kind, text, s, e)
        if got and not any(a < got[2] and got[1] < b for _, a, b in base):
            out.append(got)
    return out


def find(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id) with n_email, n_ip, n_card, n_phone (base), base_sha256 and spans."""
    sent = spark.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def work(texts: list[str]) -> dict:
            out: dict[str, list] = {x: [] for x in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            starts, ids = [], []
            for t in texts:
                own = [s for s, _ in placed_windows(t)]
                starts.append(own)
                for s in own:
                    row = np.zeros(LENGTH, np.uint8)
                    part = t[s : s + LENGTH]
                    row[: len(part)] = char_ids(part)
                    ids.append(row)
            labels = [decode(m, np.stack(ids[i : i + 1024])) for i in range(0, len(ids), 1024)]
            labels = np.concatenate(labels) if labels else np.empty((0, LENGTH), np.int8)
            at = 0
            for t, own in zip(texts, starts):
                base = base_spans(t)
                more = added_spans(t, base, own, labels[at : at + len(own)])
                at += len(own)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(sha256(shown(base).encode()).hexdigest())
                out["spans"].append(shown(in_order(base + more)))
            return out

        return work

    ddl = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_texts(docs, make, ddl, keep=["doc_id"] if keep is None else keep)
