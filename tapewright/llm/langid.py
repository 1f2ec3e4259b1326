"""Language of documents and of lines in another language.

Method: a byte convolutional network. Bytes are embedded, filters of several widths run over fixed-length windows of them, each filter keeps its
maximum over the window, and a softmax gives the languages. It is trained in numpy on labelled text: a small clean table, and a bounded
sample of labelled documents whose wrong labels are dropped by a first training. Trained weights are stored in the shared folder under a hash of what they were
trained on. The network is applied to batches of windows in Arrow batches, without a shuffle; equal lines of a batch are judged once. A window's result does not depend
on the windows beside it.

Code, links and numbers have no language and are cut out first. The main language of a document is that of most prose letters; a
line counts as another language's if the posterior of the main language is low. Evidence grows with the length of a line by a law that is fitted to held-out text, so one limit
serves lines of any length.
"""

from __future__ import annotations

import hashlib
import io
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.common import shared_dir

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")

# How the languages are written as labels (ISO 639-1, 639-2/B and T, English and own names).
LABELS = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
}
LABEL_OF = {name: code for code, names in LABELS.items() for name in names}

#: Bytes of a window, width of a byte's embedding, filter widths and filters per width; windows judged at once.
WINDOW, DEPTH, WIDTHS, FILTERS, BATCH = 96, 12, (2, 3, 4, 5), 36, 32
#: Share of a training label spread over all languages.
SMOOTHING = 0.004
#: Probability of a line's label below which the label is taken for wrong.
LEAST_LABEL = 0.4
#: Labelled documents used for training, per language (about, and never more than 4 times in all), and clean samples.
TRAIN_DOCUMENTS, TRAIN_SAMPLES = 500, 10_000
#: Prior of the main language for a line, prior of the label for the main language, least share of a window's probability, and the posterior of the main
#: language up to which a line is another's.
MAIN_PRIOR, LABEL_PRIOR, LEAST_PROBABILITY, LINE_POSTERIOR = 0.75, 0.6, 1e-5, 0.1


def label_language(label: str | None) -> str | None:
    """The language a label names, in whatever notation; None if it names none of ``LANGUAGES``."""
    if not label:
        return None
    text = label.strip().lower()
    return LABEL_OF.get(text) or LABEL_OF.get(re.split(r"[-_.@ (]", text, maxsplit=1)[0])


# -- prose ------------------------------------------------------------------------------------------------

_INLINE = re.compile(r"`[^`]*`")
_URL, _WWW, _MAIL = re.compile(r"(?:https?|ftp)://\S+", re.IGNORECASE), re.compile(r"www\.\S+", re.IGNORECASE), re.compile(r"[^\s@]+@\S+\.\S+")
_TAG, _ENTITY = re.compile(r"</?[A-Za-z][^<>]{0,200}>"), re.compile(r"&[a-z]+;")
_CALL = re.compile(r"[^\W\d]\w*(?:\.\w+)*\([^()\s]*\)")
_JOINED, _NUMBERED = re.compile(r"\b\w*_\w*\b"), re.compile(r"\b\w*\d\w*\b")
_FILE = re.compile(r"\b\w+\.(?:py|csv|json|jsonl|parquet|sql|sh|txt|log|cpp|java|rs|go)\b")
#: What is cut out of a line, each with the text without which it can't be there.
_CUTS = (("`", _INLINE), ("://", _URL), ("www.", _WWW), ("@", _MAIL), ("<", _TAG), ("&", _ENTITY))
_CODE_LINE = re.compile(r"[{}\[\];]\s*$|^\s*[{\[<$#]|==|!=|->|=>|\+\+|^\s*(?:def|class|import|from|SELECT|FROM|WHERE|GROUP BY|return|for \(|if \()\b.*[(:=;*]")


#: A line without any of these holds no code, link, number or name.
_MARK = re.compile(r"[`<&@/\\:(){}\[\];=+*$#_\d|~^%\"]|\.\w|www|^(?:def|class|import|from|SELECT|FROM|WHERE|GROUP BY|return)\b|->")
_OPEN, _DOT = re.compile(r"\w\("), re.compile(r"\.\w")
_SPACE, _DIGIT, _TWO = re.compile(r"[\W\d_]+"), re.compile(r"\d"), re.compile(r"[^\W\d_][\W\d_]*[^\W\d_]")


def _prose(line: str) -> str | None:
    """The line without code, links and numbers; None if it holds no prose."""
    if not _MARK.search(line):
        return line if _TWO.search(line) else None
    rest, lower = line, line.lower()
    for sign, cut in _CUTS:
        if sign in lower:
            rest = cut.sub(" ", rest)
    if "(" in rest and _OPEN.search(rest):
        rest = _CALL.sub(" ", rest)
    if "_" in rest:
        rest = _JOINED.sub(" ", rest)
    if "." in rest and _DOT.search(rest):
        rest = _FILE.sub(" ", rest)
    if _DIGIT.search(rest):
        rest = _NUMBERED.sub(" ", rest)
    if not _TWO.search(rest) or (_CODE_LINE.search(line) and len(_SPACE.sub("", rest)) < 0.6 * len(line.replace(" ", ""))):
        return None
    return rest


def prose_lines(text: str | None, known: dict | None = None) -> list[tuple[int, str]]:
    """(number, prose) of the lines of ``text`` that hold prose; lines count from 1, split at line feeds. ``known`` remembers lines."""
    if not text:
        return []
    known = {} if known is None else known
    out, fenced = [], False
    for n, line in enumerate(text.split("\n"), 1):
        if line.lstrip()[:3] in ("```", "~~~"):
            fenced = not fenced
            continue
        if fenced or line.startswith(("    ", "\t")) or not line.strip():
            continue
        if line in known:
            rest = known[line]
        else:
            rest = known[line] = _prose(line)
        if rest is not None:
            out.append((n, rest))
    return out


def to_bytes(prose: str) -> bytes:
    """Lower-case letters and single blanks, a blank at either end."""
    return (" " + _SPACE.sub(" ", prose.lower()).strip() + " ").encode("utf-8", "replace")


# -- the network ------------------------------------------------------------------------------------------

_WIDEST = max(WIDTHS)
#: Which rows of the filter matrix a filter may use: those of its own width.
_MASK = np.repeat(np.stack([(np.arange(_WIDEST * DEPTH) < w * DEPTH) for w in WIDTHS], 1), FILTERS, 1).astype(np.float32)


@dataclass
class ByteNet:
    """Weights: embedding of bytes (0 is padding and stays 0), filters of all widths as one matrix, their biases, a dense layer to the languages; and how evidence grows with length."""

    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    evidence: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    @staticmethod
    def fresh(seed: int = 7, classes: int = len(LANGUAGES)) -> "ByteNet":
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        net = ByteNet(rng.normal(0, 1, (256, DEPTH)), rng.normal(0, 0.25, (_WIDEST * DEPTH, n)) * _MASK, np.zeros(n), rng.normal(0, 0.1, (n, classes)), np.zeros(classes))
        net.bytes_[0] = 0
        for k in ("bytes_", "filters", "bias", "dense", "offset"):
            setattr(net, k, getattr(net, k).astype(np.float32))
        return net

    def views(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, widest * depth): the embedded bytes that start at each place, padded with 0 behind the end."""
        n, length = x.shape
        e = np.zeros((n, length - 2 + _WIDEST, DEPTH), np.float32)
        e[:, :length] = self.bytes_[x]
        return np.lib.stride_tricks.as_strided(e, (n, length - 1, _WIDEST * DEPTH), (e.strides[0], e.strides[1], e.strides[2]))

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows ``x`` (n, length) of bytes, all of one length."""
        n, length = x.shape
        # Place by place, so that the maxima run over whole blocks of memory.
        seen = np.ascontiguousarray(self.views(x).transpose(1, 0, 2)).reshape(-1, _WIDEST * DEPTH)
        s = (seen @ self.filters).reshape(length - 1, n, -1).max(0)
        z = (np.maximum(s + self.bias, 0) @ self.dense + self.offset).astype(np.float64)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> "ByteNet":
        return ByteNet(**np.load(io.BytesIO(data)))


def windows_of(data: bytes) -> list[tuple[bytes, float]]:
    """(window, weight) that cover ``data``: windows of ``WINDOW`` bytes, the last one ending with it and weighing what it adds. Shorter data is one window."""
    if len(data) <= WINDOW:
        return [(data if len(data) > 1 else data + b"  ", 1.0)]
    out = [(data[i : i + WINDOW], 1.0) for i in range(0, len(data) - WINDOW + 1, WINDOW)]
    rest = len(data) % WINDOW
    return [*out, (data[-WINDOW:], rest / WINDOW)] if rest else out


def batched_log_probs(net: ByteNet, parts: list[bytes]) -> np.ndarray:
    """Log-probabilities of windows. Batches hold ``BATCH`` windows of one length, the last one filled up with zeros, so all products of matrices have the same shape."""
    out = np.zeros((len(parts), len(LANGUAGES)))
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        by_length.setdefault(len(p), []).append(i)
    for length, ids in by_length.items():
        x = np.zeros((-(-len(ids) // BATCH) * BATCH, length), np.uint8)
        x[: len(ids)] = np.frombuffer(b"".join([parts[i] for i in ids]), np.uint8).reshape(len(ids), length)
        for k in range(0, len(ids), BATCH):
            mine = ids[k : k + BATCH]
            out[mine] = net.log_probs(x[k : k + BATCH])[: len(mine)]
    return out


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = 800, seed: int = 7, batch: int = 64, rate: float = 6e-3, start: ByteNet | None = None) -> ByteNet:
    """Adam on the cross-entropy of random windows of random length, languages drawn evenly; from the weights of ``start`` on, if given."""
    rng = np.random.default_rng(seed)
    net = start or ByteNet.fresh(seed)
    by_class = [np.flatnonzero(labels == c) for c in range(len(LANGUAGES))]
    present = [c for c in range(len(LANGUAGES)) if len(by_class[c])]
    draw = [np.cumsum(weights[i] / weights[i].sum()) if len(i) else None for i in by_class]
    params = [net.bytes_, net.filters, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    mean = [np.zeros_like(p) for p in params]
    rows = np.arange(batch)[:, None]
    for step in range(1, steps + 1):
        cls = rng.choice(present, batch)
        size = np.where(rng.random(batch) < 0.7, rng.integers(10, WINDOW + 1, batch), WINDOW)
        parts = []
        for c, u, v, n in zip(cls, rng.random(batch), rng.random(batch), size):
            d = texts[by_class[c][min(int(np.searchsorted(draw[c], u)), len(draw[c]) - 1)]]
            s = int(v * (max(len(d) - n, 0) + 1))
            parts.append(d[s : s + n])
        length = np.array([len(p) for p in parts])
        x = np.zeros((batch, max(int(length.max()), 2)), np.uint8)
        for i, p in enumerate(parts):
            x[i, : len(p)] = np.frombuffer(p, np.uint8)
        views = net.views(x)
        scores = (views.reshape(-1, _WIDEST * DEPTH) @ net.filters).reshape(batch, x.shape[1] - 1, -1)
        scores[np.arange(x.shape[1] - 1)[None, :] >= np.maximum(length - 1, 1)[:, None]] = -np.inf
        at = scores.argmax(1)
        h = np.maximum(np.take_along_axis(scores, at[:, None, :], 1)[:, 0] + net.bias, 0)
        keep = rng.random(h.shape, dtype=np.float32) > 0.2
        hd = h * keep / 0.8
        z = hd @ net.dense + net.offset
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        # Labels may be wrong: a little of each is spread over all languages.
        target = np.full_like(p, SMOOTHING / p.shape[1])
        target[np.arange(batch), cls] += 1 - SMOOTHING
        gz = (p - target) / batch
        gh = (gz @ net.dense.T) * keep / 0.8 * (h > 0)
        picked = views[rows, at]  # (batch, filters, widest * depth): what each filter saw at its maximum
        g_filters = np.einsum("bf,bfk->kf", gh, picked, optimize=True) * _MASK
        seen = np.pad(x, ((0, 0), (0, _WIDEST - 2)))[rows[:, :, None], at[:, :, None] + np.arange(_WIDEST)]  # their bytes
        g_seen = (gh[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
        g_bytes = np.stack([np.bincount(seen.reshape(-1), g_seen[:, k], 256) for k in range(DEPTH)], 1).astype(np.float32)
        g_bytes[0] = 0
        grads = [g_bytes, g_filters, gh.sum(0), hd.T @ gz, gz.sum(0)]
        lr = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for q, g, a, b in zip(params, grads, first, second):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        if step > steps // 2:  # the mean of the weights over the second half errs less than the last ones
            for m, q in zip(mean, params):
                m += (q - m) / (step - steps // 2)
    for m, q in zip(mean, params):
        q[...] = m
    return net


# -- training on tables -----------------------------------------------------------------------------------


def training_sample(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample of labelled documents, by a hash of the id, about as many of each language."""
    label = F.lower(F.trim("lang"))
    primary = F.split(label, "[-_.@ (]")[0]
    known = F.create_map(*[x for k, v in LABEL_OF.items() for x in (F.lit(k), F.lit(v))])
    labelled = docs.select("doc_id", "text", F.coalesce(F.try_element_at(known, label), F.try_element_at(known, primary)).alias("_l")).filter("_l is not null")
    counts = {r["_l"]: r["n"] for r in labelled.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    rows = labelled.withColumn("_at", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)).filter(F.col("_at") < share[F.col("_l")])
    rows = rows.orderBy("_at", "doc_id", "text").limit(4 * per_language * len(LANGUAGES)).select("_l", "doc_id", "text").collect()
    return [(r["_l"], r["text"]) for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["text"] or ""))]


def fit(samples: list[tuple[str, str]], documents: list[tuple[str, str]], steps: int = 800, seed: int = 7) -> ByteNet:
    """Train on clean samples and noisy documents: the network drops the lines whose label it rejects and goes on with the rest. A tenth of the lines is held out to fit how evidence grows with length."""
    code = {c: i for i, c in enumerate(LANGUAGES)}
    clean = [(code[c], to_bytes(t)) for c, t in samples if c in code and t]
    lines = [(code[c], to_bytes(p)) for c, t in documents if c in code for _, p in prose_lines(t)]
    noisy, held = [x for i, x in enumerate(lines) if i % 10], lines[::10]
    texts = [t for _, t in clean + noisy]
    labels = np.array([c for c, _ in clean + noisy])
    weights = np.array([3.0 * max(len(noisy), 1) / max(len(clean), 1) / 10] * len(clean) + [1 + min(len(t), 2 * WINDOW) / WINDOW for _, t in noisy])
    net = train(texts, labels, weights, steps, seed)
    if noisy:
        good = np.r_[np.ones(len(clean), bool), accepted(net, noisy)]
        net = train([t for t, g in zip(texts, good) if g], labels[good], weights[good], steps, seed + 1, start=net)
        calibrate(net, [x for x, g in zip(held, accepted(net, held)) if g], seed)
    return net


def accepted(net: ByteNet, lines: list[tuple[int, bytes]]) -> np.ndarray:
    """Which labelled lines are kept. Of three or more equal lines those with the label of most; of others those whose label the network doesn't reject."""
    scores = _normalized(_raw_scores(net, [t for _, t in lines])) if lines else np.zeros((0, 1))
    own = np.array([scores[i][c] for i, (c, _) in enumerate(lines)], float)
    votes: dict[bytes, dict[int, int]] = {}
    for c, t in lines:
        of = votes.setdefault(t, {})
        of[c] = of.get(c, 0) + 1
    share = np.array([votes[t][c] / sum(votes[t].values()) if sum(votes[t].values()) >= 3 else np.nan for c, t in lines])
    return np.where(np.isnan(share), own > np.log(LEAST_LABEL), share > 0.5)


def calibrate(net: ByteNet, lines: list[tuple[int, bytes]], seed: int) -> None:
    """Set how evidence grows: log-likelihoods count a n / (n + b) of their size for n bytes, by the least cross-entropy of held-out lines cut to random lengths."""
    rng = np.random.default_rng(seed)
    cut = []
    for c, t in lines:
        n = int(rng.integers(6, WINDOW))
        s = int(rng.integers(0, max(len(t) - n, 0) + 1))
        cut.append((c, t[s : s + n]))
    if not cut:
        return
    net.evidence = np.array([1.0, 0.0])
    raw = _raw_scores(net, [t for _, t in cut])
    n = np.array([[len(t)] for _, t in cut], float)
    own = np.array([c for c, _ in cut])

    def loss(a: float, b: float) -> float:
        return -_normalized(raw * (a * n / (n + b)))[np.arange(len(own)), own].mean()

    net.evidence = np.array(min(((a, b) for a in np.arange(0.3, 1.51, 0.1) for b in (0, 2, 4, 8, 12, 16, 24, 32, 48)), key=lambda x: loss(*x)), float)


def _raw_scores(net: ByteNet, lines: list[bytes]) -> np.ndarray:
    """Log-probabilities of the windows of each line added by weight, none below ``LEAST_PROBABILITY``."""
    parts, owner, weight = [], [], []
    for i, d in enumerate(lines):
        for w, share in windows_of(d):
            parts.append(w)
            owner.append(i)
            weight.append(share)
    out = np.zeros((len(lines), len(LANGUAGES)))
    if parts:
        np.add.at(out, np.array(owner), np.maximum(batched_log_probs(net, parts), np.log(LEAST_PROBABILITY)) * np.array(weight)[:, None])
    return out


def _normalized(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def line_scores(net: ByteNet, lines: list[bytes]) -> np.ndarray:
    """Normalized log-probabilities of lines: those of their windows, counted by the law of evidence."""
    if not lines:
        return np.zeros((0, len(LANGUAGES)))
    n = np.array([[len(t)] for t in lines], float)
    a, b = net.evidence
    return _normalized(_raw_scores(net, lines) * (a * n / (n + b)))


def _priors(share: float) -> np.ndarray:
    """Logs of the priors that give one language ``share`` and the others the rest evenly, a row per language; the last row favours none."""
    n = len(LANGUAGES)
    out = np.full((n + 1, n), np.log((1 - share) / (n - 1)))
    out[np.arange(n), np.arange(n)] = np.log(share)
    out[n] = 0
    return out


def _posterior(scores: np.ndarray) -> np.ndarray:
    q = np.exp(scores - scores.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def judge_all(counts: np.ndarray, scores: np.ndarray, letters: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(main language, confidence) of documents and (language, confidence) of their lines.

    ``counts``: lines of each document (at least one), whose ``scores`` and ``letters`` follow each other; ``labels``: code of the language the document's label names, the number of languages if none.
    Main language and lines' languages depend on each other: they are found in turn until nothing changes, or a main language comes up again; then the one of most letters among those seen stays.
    """
    n = len(LANGUAGES)
    docs, lines = np.arange(len(counts)), np.arange(len(scores))
    owner, first = np.repeat(docs, counts), np.r_[0, np.cumsum(counts)[:-1]]
    # The label counts once per document, however many lines there are.
    p = _posterior(scores + (_priors(LABEL_PRIOR)[labels] / counts[:, None])[owner])
    main = np.add.reduceat(p * letters[:, None], first).argmax(1)
    prior, seen, todo = _priors(MAIN_PRIOR), np.full((len(counts), n), -1.0), np.ones(len(counts), bool)

    def read(main: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = _posterior(scores + prior[main[owner]])
        lang = np.where(q[lines, main[owner]] <= LINE_POSTERIOR, q.argmax(1), main[owner])
        return q, lang, np.bincount(owner * n + lang, weights=letters, minlength=len(counts) * n).reshape(-1, n)

    while todo.any():
        q, lang, share = read(main)
        own = share[docs, main]
        seen[docs[todo], main[todo]] = own[todo]
        todo &= own < share.max(1)
        again = todo & (seen[docs, share.argmax(1)] >= 0)
        main = np.where(again, seen.argmax(1), np.where(todo, share.argmax(1), main))
        todo &= ~again
        if again.any() and not todo.any():
            q, lang, _ = read(main)
    confidence = q[lines, lang]
    whole = np.add.reduceat(np.where(lang == main[owner], letters * confidence, 0.0), first) / np.maximum(np.add.reduceat(letters, first), 1.0)
    return main, whole.round(6), lang, confidence.round(6)


def judge(lines: list[tuple[int, str]], scores: np.ndarray, label: str | None = None, letters: np.ndarray | None = None) -> tuple[int, float, list[tuple[int, int, float]]]:
    """(main language, confidence, [(line, language, confidence)]) of one document, from the scores of its prose lines."""
    if letters is None:
        letters = np.array([len(_SPACE.sub("", p)) for _, p in lines], float)
    code = LANGUAGES.index(label) if label in LANGUAGES else len(LANGUAGES)
    main, whole, lang, q = judge_all(np.array([len(lines)]), scores, letters, np.array([code]))
    return int(main[0]), float(whole[0]), [(n, int(c), float(x)) for (n, _), c, x in zip(lines, lang, q)]


_OUT = "doc_id long, line_no int, lang string, confidence double, label string, main string"


def detect(docs: DataFrame, net: ByteNet) -> DataFrame:
    """Language of every document (``line_no`` 0) and of every line with prose: ``doc_id``, ``line_no``, ``lang``, ``confidence``, ``label``, ``main``.

    ``main`` is the document's language, ``label`` what the document's own label names, null if nothing. Narrow. Defined results: a document without prose (null, empty, code
    only) has one row of line_no 0 with a null lang and confidence 0; repeated documents each have their rows; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net.save())  # some 50 kB, by its fixed shape

    def run(batches):
        model = ByteNet.load(shared.value)
        names = np.array([*LANGUAGES, None], object)
        for pdf in batches:
            known: dict = {}
            found = [prose_lines(t, known) for t in pdf["text"]]
            own = pdf["lang"].map({x: label_language(x) for x in pdf["lang"].unique()})
            counts = np.array([len(x) for x in found])
            # Equal lines of the batch are judged once.
            place: dict[str, int] = {}
            ids = np.array([place.setdefault(p, len(place)) for lines in found for _, p in lines], int)
            clean = [to_bytes(p) for p in place]
            scores, letters = line_scores(model, clean), np.array([len(b.decode("utf-8", "replace")) - b.count(b" ") for b in clean], float)
            has = counts > 0
            codes = own.map(lambda x: LANGUAGES.index(x) if x in LANGUAGES else len(LANGUAGES)).to_numpy(int)
            main, whole = np.full(len(pdf), len(LANGUAGES)), np.zeros(len(pdf))
            lang, q = np.zeros(0, int), np.zeros(0)
            if has.any():
                main[has], whole[has], lang, q = judge_all(counts[has], scores[ids], letters[ids], codes[has])
            owner = np.repeat(np.arange(len(pdf)), counts)
            at, label = pdf["doc_id"].to_numpy(), own.to_numpy(object)
            yield pd.DataFrame({"doc_id": at, "line_no": 0, "lang": names[main], "confidence": whole, "label": label, "main": names[main]})
            yield pd.DataFrame({"doc_id": at[owner], "line_no": np.array([n for lines in found for n, _ in lines], int), "lang": names[lang], "confidence": q, "label": label[owner], "main": names[main[owner]]})

    return docs.select("doc_id", "text", "lang").mapInPandas(run, _OUT)


def fit_tables(spark: SparkSession, samples: DataFrame, docs: DataFrame, per_language: int = TRAIN_DOCUMENTS, steps: int = 800, max_samples: int = TRAIN_SAMPLES) -> ByteNet:
    """Train on a table of samples (lang, text; at most ``max_samples`` of them, by hash) and a bounded sample of ``docs``; or load the weights if the shared folder holds those of the same texts and parameters."""
    clean = samples.select("lang", "text").orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(max_samples).collect()
    clean, noisy = [(r["lang"], r["text"]) for r in clean], training_sample(docs, per_language)
    settings = (WINDOW, DEPTH, WIDTHS, FILTERS, SMOOTHING, steps)
    path = f"{shared_dir(spark)}/tapewright-langid-{hashlib.sha256(repr((settings, clean, noisy)).encode()).hexdigest()}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([(bytearray(fit(clean, noisy, steps).save()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return ByteNet.load(bytes(spark.read.parquet(path).first()["weights"]))


def wrong_labels(found: DataFrame) -> DataFrame:
    """Of ``detect``: documents whose label isn't their main language (line_no 0), and lines in another one: ``doc_id``, ``line_no``, ``lang``."""
    wrong = F.when(F.col("line_no") == 0, ~F.col("label").eqNullSafe(F.col("lang"))).otherwise(F.col("lang") != F.col("main"))
    return found.filter(F.col("lang").isNotNull() & wrong).select("doc_id", "line_no", "lang")
