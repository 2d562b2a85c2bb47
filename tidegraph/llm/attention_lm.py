"""Language-model scoring: a small causal self-attention model over subword ids, in numpy.

Texts are lower-cased (A-Z) words; each word becomes the subword ids of a public tokenizer.
A token's probability is that of its class, given the context, times its share of the class
after the token before it: frequent tokens are classes of their own, the others are clustered
by their neighbours.  The class distribution comes from one attention layer over a window of
earlier tokens plus a bigram table, trained here by Adam with hand-written gradients.

All training documents are learned from, and nothing is sampled.  Their tokens are kept while the model
is fitted: classes come from the counts of all tokens and of their neighbours, first weights from steps
on every window, in rounds after which the tasks' weights are averaged.  Then the documents are read in blocks of
texts, and each block counts its tokens after the tokens before them, for the shares, and goes over some
of its windows once more.  Counts are added up and weights averaged over all blocks.  Counts reach the
driver as tables bounded by the vocabulary (``SHARE_ROWS`` rows and some, a column a token).

A text is cut into windows of ``WINDOW`` tokens that overlap by ``CONTEXT``; each window
scores the tokens after its context, so every token is scored once.  Windows are scored in
batches with a causal mask.

The base score needs the counts of all words of all training documents.  A block sends each of
its distinct words once, and gets its count back, so that the shuffle carries a block's
vocabulary and not its text.

Defined cases: null and empty texts are the end token alone; repeated rows count and score
each; rows with a null id belong to the fold of the empty string; ids of any type pass through
untouched; columns besides id, text and fold are not looked at; ties of frequency go to the smaller token; an empty table gives no rows;
without training rows the model is uniform and all counts are 0; very long texts are scored whole.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
#: Classes (the last ``CLUSTERS`` are clusters of rarer tokens), width, and input rows of the frequent tokens.
CLASSES, CLUSTERS, WIDTH, ROWS = 64, 12, 16, 1024
#: Frequent tokens after which the shares of a class are counted apart; after others they are counted by class.
SHARE_ROWS = 1024
#: Characters of text that make one block.
BLOCK_CHARS = 12_000_000
#: Characters of text that make one row of tokens while the model is fitted, when tasks keep less in memory than blocks do.
TOKEN_CHARS = 3_000_000
#: Rounds of a pass over all training windows, and windows of a step.
ROUNDS, WINDOWS_A_STEP = 8, 96
#: Most tasks of a round: each sends its weights (some 100 KB) to the driver.
MOST_TASKS = 512
#: One in so many windows of the training documents refines the weights once more.
REFINE = 64


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Subword ids of words, by a public byte-level BPE vocabulary read from its file."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.size = len(ranks) + 1
        self.end = len(ranks)  # free in the vocabulary: the end of a text
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, word: bytes) -> list[int]:
        return self.bpe.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each word starts."""
        ids, sizes = [], []
        for i in range(0, len(words), 20_000):  # lists of ids are large, so only some at a time
            parts = [self.ids(w) for w in words[i : i + 20_000]]
            sizes.append(np.fromiter(map(len, parts), np.int64, len(parts)))
            ids.append(np.fromiter(chain.from_iterable(parts), np.int32, int(sizes[-1].sum())))
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype(np.int32), *ids]), np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])


def split(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space \\x20 \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@dataclass
class Model:
    """Weights; for every token id its class, input row and share of its class; the shares after each row of the tokens before."""

    of_class: np.ndarray
    row: np.ndarray
    before: np.ndarray  # row of a token for the shares after it
    share: np.ndarray  # log share of the class, whatever goes before
    w: dict[str, np.ndarray]
    column: np.ndarray  # of ``after`` for each token id, -1 for tokens that were not seen
    after: np.ndarray  # [rows, tokens seen]: log share of the class after that row
    back: np.ndarray  # [rows, CLASSES]: what a token that was not seen gets besides ``share``


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and the place in it of the first token that the window scores."""
    count = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(sizes)), count)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def places(owner: np.ndarray, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens that some windows score lie ([n, STRIDE], -1 where the text is over), and where their texts start."""
    offset = first[:, None] + np.arange(STRIDE)
    return np.where(offset < sizes[owner][:, None], starts[owner][:, None] + offset, -1), starts[owner]


def batch(tokens: np.ndarray, at: np.ndarray, start: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows [n, WINDOW], classes of the token before each scored one, classes to predict [n, STRIDE]."""
    first = at[:, 0]
    place = first[:, None] + np.arange(-CONTEXT - 1, STRIDE - 1)
    inside = (place >= start[:, None]) & (place < len(tokens))
    tok = tokens[np.where(inside, place, 0)]
    outside = np.where(place == start[:, None] - 1, ROWS + CLASSES, ROWS + CLASSES + 1)  # start of the text, nothing
    rows = np.where(inside, m.row[tok], outside)
    before = np.where(inside, m.of_class[tok], np.where(outside == ROWS + CLASSES, CLASSES, CLASSES + 1))[:, CONTEXT:]
    return rows, before, m.of_class[tokens[np.maximum(at, 0)]]


MASK = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)


def forward(w: dict[str, np.ndarray], rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits [n, STRIDE, CLASSES] by one causally masked attention layer, and what the gradients need."""
    n = len(rows)
    x = w["embed"][rows] + w["place"]
    qkv = (x.reshape(-1, WIDTH) @ w["qkv"]).reshape(n, WINDOW, 3 * WIDTH)
    q, k, v = qkv[:, CONTEXT:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= MASK
    a /= a.sum(2, keepdims=True)
    h = np.concatenate([x[:, CONTEXT:], np.matmul(a, v)], axis=2)
    logits = (h.reshape(-1, 2 * WIDTH) @ w["out"]).reshape(n, STRIDE, CLASSES)
    logits += w["bigram"][before]
    return logits, {"x": x, "q": q, "k": k, "v": v, "a": a, "h": h}


def step(w: dict[str, np.ndarray], rows: np.ndarray, before: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the live targets and its gradients."""
    logits, c = forward(w, rows, before)
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    n = max(1, live.sum())
    hit = np.take_along_axis(p, target[:, :, None], 2)[:, :, 0]
    loss = float(-(np.log(hit + 1e-20) * live).sum() / n)
    d = p
    np.put_along_axis(d, target[:, :, None], (hit - 1)[:, :, None], 2)
    d *= (live / n)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    flat = d.reshape(-1, CLASSES)
    hot = np.zeros((len(flat), CLASSES + 2), np.float32)
    hot[np.arange(len(flat)), before.ravel()] = 1
    g["bigram"] = hot.T @ flat
    g["out"] = c["h"].reshape(-1, 2 * WIDTH).T @ flat
    dh = (flat @ w["out"].T).reshape(*d.shape[:2], 2 * WIDTH)
    dx = np.zeros_like(c["x"])
    dx[:, CONTEXT:] = dh[:, :, :WIDTH]
    dav = dh[:, :, WIDTH:]
    dv = np.matmul(c["a"].transpose(0, 2, 1), dav)
    da = np.matmul(dav, c["v"].transpose(0, 2, 1))
    ds = c["a"] * (da - (da * c["a"]).sum(2, keepdims=True))
    dq, dk = np.zeros_like(c["x"]), np.matmul(ds.transpose(0, 2, 1), c["q"])
    dq[:, CONTEXT:] = np.matmul(ds, c["k"])
    dqkv = np.concatenate([dq, dk, dv], axis=2).reshape(-1, 3 * WIDTH)
    g["qkv"] = c["x"].reshape(-1, WIDTH).T @ dqkv
    dx += (dqkv @ w["qkv"].T).reshape(dx.shape)
    g["place"] = dx.sum(0)
    cells = (rows.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
    g["embed"] = np.bincount(cells, weights=dx.ravel(), minlength=w["embed"].size).reshape(w["embed"].shape).astype(np.float32)
    return loss, g


def classes_of(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, input row and row of shares of every token id, from some tokens."""
    count = np.bincount(ids, minlength=size)
    around = np.bincount(neighbours(ids, np.zeros(1, np.int64), ranks(count)), minlength=size * SIDES) if len(ids) else np.zeros(size * SIDES)
    return classes_from(count, around)


SIDES = 2 * (CLASSES - CLUSTERS + 1)  # each frequent token, and all others, before and after


def ranks(count: np.ndarray) -> np.ndarray:
    """The place of every token id by frequency."""
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    return rank


def neighbours(ids: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A cell (token, side) for each neighbour that a token has in its text."""
    own = np.minimum(rank, CLASSES - CLUSTERS)
    inside = np.ones(len(ids), bool)
    inside[starts] = False
    later = np.flatnonzero(inside)
    return np.concatenate([ids[later].astype(np.int64) * SIDES + own[ids[later - 1]], ids[later - 1].astype(np.int64) * SIDES + SIDES // 2 + own[ids[later]]])


def classes_from(count: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, input row and row of shares of every token id, from counts of tokens and of (token, side) cells."""
    size, count = len(count), count.astype(float)
    rank = ranks(count)
    order = np.argsort(-count, kind="stable")
    single = CLASSES - CLUSTERS
    around = around.reshape(size, SIDES).astype(np.float32)
    rest = order[single:]
    seen = rest[count[rest] >= 3]
    of_class = np.where(rank < single, rank, single)
    if len(seen) >= CLUSTERS:
        x = np.sqrt(around[seen] / np.maximum(around[seen].sum(1, keepdims=True), 1))
        centre = x[:: max(1, len(x) // CLUSTERS)][:CLUSTERS].copy()
        for _ in range(15):  # spherical k-means, weighted by frequency
            near = (x @ centre.T).argmax(1)
            for k in range(len(centre)):
                if (near == k).any():
                    mean = (x[near == k] * np.sqrt(count[seen[near == k]])[:, None]).sum(0)
                    centre[k] = mean / max(np.linalg.norm(mean), 1e-9)
        of_class[seen] = single + near
    row = np.where((rank < ROWS) & (count >= 3), rank, ROWS + of_class)
    before = np.where((rank < SHARE_ROWS) & (count >= 3), rank, SHARE_ROWS + of_class)
    return of_class.astype(np.int32), row.astype(np.int32), before.astype(np.int32)


START = SHARE_ROWS + CLASSES  # the row before a text's first token


def pairs_of(tokens: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row of the token before, token) pairs of some texts as one number each, and their counts."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.empty(len(tokens), np.int32 if (START + 1) * len(before) < 2**31 else np.int64)
    at[1:] = before[tokens[:-1]]
    at[starts] = START
    at *= len(before)
    at += tokens
    pairs, n = np.unique(at, return_counts=True)
    return pairs.astype(np.int64), n


def with_shares(m: Model, pairs: np.ndarray, n: np.ndarray, prior: float = 8.0) -> Model:
    """The model with shares of the classes from pair counts: after a row, backed off to the plain shares by ``prior``."""
    size = len(m.before)
    at, token = pairs // size, pairs % size
    smooth = np.bincount(token, weights=n, minlength=size) + 0.02
    share = np.log(smooth / np.bincount(m.of_class, weights=smooth, minlength=CLASSES)[m.of_class])
    seen = np.unique(token)
    column = np.full(size, -1, np.int32)
    column[seen] = np.arange(len(seen))
    counts = np.zeros((START + 1, len(seen)), np.float32)
    np.add.at(counts, (at, column[token]), n)
    total = np.zeros((START + 1, CLASSES), np.float32)
    np.add.at(total, (at, m.of_class[token]), n)
    for lo in range(0, len(seen), 4096):  # in place, a stretch of columns at a time
        some = seen[lo : lo + 4096]
        counts[:, lo : lo + 4096] = np.log((counts[:, lo : lo + 4096] + prior * np.exp(share[some]).astype(np.float32)) / (total[:, m.of_class[some]] + prior))
    return replace(m, share=share.astype(np.float32), column=column, after=counts, back=np.log(prior / (total + prior)).astype(np.float32))


def share_scores(tokens: np.ndarray, starts: np.ndarray, m: Model) -> np.ndarray:
    """For each text the natural log probability of its tokens given their classes and the tokens before."""
    if not len(starts):
        return np.zeros(0)
    before = np.empty(len(tokens), np.int32)
    before[1:] = m.before[tokens[:-1]]
    before[starts] = START
    column = m.column[tokens]
    known = column >= 0
    lp = np.empty(len(tokens), np.float32)
    lp[known] = m.after[before[known], column[known]]
    rest = tokens[~known]
    lp[~known] = m.share[rest] + m.back[before[~known], m.of_class[rest]]
    return np.add.reduceat(lp.astype(float), starts)


def adam(w: dict[str, np.ndarray], batches: Iterator[tuple], rate) -> None:
    """Steps on (input rows, classes before, classes to predict, live) batches, in place; ``rate`` of the step's number."""
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t, (rows, before, target, live) in enumerate(batches, 1):
        _, g = step(w, rows, before, target, live)
        for k, v in w.items():
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            v -= (rate(t) * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def train(texts: list[list[int]], size: int, steps: int = 700, windows_a_step: int = 96, rate: float = 4e-3, seed: int = 1) -> Model:
    """Fit the classes, the bigram table (from counts, then trained) and the attention layer by Adam; shares are those of the texts."""
    rng = np.random.default_rng(seed)
    tokens = np.concatenate([np.asarray(t, np.int64) for t in texts]) if texts else np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    of_class, row, before = classes_of(tokens, size)
    none = np.zeros(0)
    m = with_shares(Model(of_class, row, before, none, {}, none, none, none), *pairs_of(tokens, starts, before))
    m.w = first_weights(rng)
    if not len(tokens):
        m.w["out"][:] = 0
        return m
    owner, begin = windows(sizes)
    cls = of_class[tokens]
    pairs = np.zeros((CLASSES + 2, CLASSES))
    np.add.at(pairs, (cls[:-1], cls[1:]), 1)
    np.add.at(pairs, (np.full(len(starts), CLASSES), cls[starts]), 1)
    m.w["bigram"] = bigram_table(pairs, np.bincount(cls, minlength=CLASSES))

    def batches() -> Iterator[tuple]:
        for _ in range(steps):
            some = rng.integers(0, len(owner), min(windows_a_step, len(owner)))
            yield targets(tokens, owner[some], begin[some], starts, sizes, m)

    adam(m.w, batches(), lambda t: rate * min(1, t / 50) * (1 - 0.95 * t / steps))
    return m


def first_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {
        "embed": rng.normal(0, 0.3, (ROWS + CLASSES + 2, WIDTH)), "place": rng.normal(0, 0.1, (WINDOW, WIDTH)),
        "qkv": rng.normal(0, 0.25, (WIDTH, 3 * WIDTH)), "out": rng.normal(0, 0.1, (2 * WIDTH, CLASSES)), "bigram": np.zeros((CLASSES + 2, CLASSES)),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def bigram_table(pairs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after a class (or the start of a text, or nothing), from counts of pairs and of classes."""
    prior = count + 0.5
    prior /= prior.sum()
    return np.log((pairs + 5 * prior) / (pairs.sum(1, keepdims=True) + 5)).astype(np.float32)


def targets(tokens: np.ndarray, owner: np.ndarray, begin: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: Model) -> tuple:
    """A training batch of some windows."""
    at, start = places(owner, begin, starts, sizes)
    rows, before, target = batch(tokens, at, start, m)
    return rows, before, target.astype(np.int64), (at >= 0).astype(np.float32)


def refined(m: Model, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, every: int = REFINE, rate: float = 5e-4) -> tuple[dict[str, np.ndarray], int]:
    """Weights after steps on one in ``every`` windows of some texts, and the number of these windows."""
    owner, begin = windows(sizes)
    some = np.arange(every // 2, len(owner), every)
    w = {k: v.copy() for k, v in m.w.items()}
    parts = np.array_split(some, max(1, len(some) // 96)) if len(some) else []
    adam(w, (targets(tokens, owner[x], begin[x], starts, sizes, m) for x in parts), lambda t: rate * min(1, t / 10))
    return w, len(some)


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as one array, in the order of their names."""
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(sorted(like), np.split(flat, ends[:-1]), strict=True)}


def tables(m: Model) -> dict[str, np.ndarray]:
    """The layer's products with every input row and place, computed once: a score only looks them up and adds."""
    of_row = np.concatenate([np.zeros(ROWS, np.int64), np.arange(CLASSES + 2)])
    own = m.row < ROWS
    of_row[m.row[own]] = m.of_class[own]
    near, far = m.w["out"][:WIDTH], m.w["out"][WIDTH:]
    head = m.w["embed"] @ near + m.w["bigram"][of_row]
    return {"qkv": m.w["embed"] @ m.w["qkv"], "qkv_place": m.w["place"] @ m.w["qkv"], "head": head, "head_place": m.w["place"][CONTEXT:] @ near, "far": far}


def logits_of(t: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The logits of ``forward``, from the tables; the class before a scored token follows from its row."""
    n = len(rows)
    qkv = t["qkv"].take(rows, axis=0)
    qkv += t["qkv_place"]
    a = np.matmul(qkv[:, CONTEXT:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1))
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= MASK
    seen = np.matmul(a, qkv[:, :, 2 * WIDTH :])
    seen /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(n, STRIDE, 1)
    logits = (seen.reshape(-1, WIDTH) @ t["far"]).reshape(n, STRIDE, CLASSES)
    logits += t["head"].take(rows[:, CONTEXT:], axis=0)
    logits += t["head_place"]
    return logits


def class_scores(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: Model, most: int = 160) -> np.ndarray:
    """For each text the natural log probability of its class sequence."""
    owner, begin = windows(sizes)
    per, t = np.zeros(len(owner)), tables(m)
    ones, cells = np.ones(CLASSES, np.float32), np.arange(most * STRIDE) * CLASSES
    for i in range(0, len(owner), most):
        at, start = places(owner[i : i + most], begin[i : i + most], starts, sizes)
        rows, _, target = batch(tokens, at, start, m)
        logits = logits_of(t, rows).reshape(-1, CLASSES)
        np.clip(logits, -60, 60, out=logits)
        hit = logits.ravel().take(cells[: len(logits)] + target.ravel())
        np.exp(logits, out=logits)
        hit -= np.log(logits @ ones)
        per[i : i + most] = np.where(at >= 0, hit.reshape(at.shape), 0).sum(1, dtype=float)
    count = -(-sizes // STRIDE)
    return np.add.reduceat(per, np.cumsum(count) - count) if len(sizes) else np.zeros(0)


def log_probabilities(flat: np.ndarray, starts: np.ndarray, seq: np.ndarray, sizes: np.ndarray, m: Model, most: int = 400_000) -> np.ndarray:
    """For each text its log10 probability; see ``tokens_of`` for the texts."""
    per_text = np.add.reduceat(np.diff(starts)[seq], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)
    upto = np.cumsum(per_text)
    out, i, at = np.zeros(len(sizes)), 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most)))
        here = seq[at : at + sizes[i:j].sum()]
        tokens, counts = tokens_of(flat, starts, here, sizes[i:j])
        first = np.cumsum(counts) - counts
        out[i:j] = class_scores(tokens, first, counts, m) + share_scores(tokens, first, m)
        at += len(here)
        i = j
    return out / np.log(10)


def fit(docs: DataFrame, path: str, steps: int = 700, rate: float = 4e-3, seed: int = 1, block_chars: int = TOKEN_CHARS) -> Model:
    """Classes and first weights from all documents; shares are plain ones until blocks have counted theirs.

    Every window is gone over once in ``ROUNDS`` rounds; after a round the mean of the tasks' weights goes on.
    Documents too few for ``steps`` steps are gone over again, in fewer tasks and rounds.
    """
    spark, folder = docs.sparkSession, f"{common.shared_dir(docs.sparkSession)}/lm-tokens-{uuid.uuid4().hex}"
    read_tokens(docs, path, block_chars).write.parquet(folder)
    texts = spark.read.schema(TOKENS).parquet(folder)
    size, n = Words(path).size, texts.agg(F.sum("n_windows")).collect()[0][0] or 0
    if not n:
        common.drop_folder(spark, folder)
        return train([], size)
    count = summed(texts, size, lambda tokens, starts: tokens)
    rank = ranks(count)
    of_class, row, before = classes_from(count, summed(texts, size * SIDES, lambda tokens, starts: neighbours(tokens, starts, rank)))

    def class_pairs(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        cls = of_class[tokens].astype(np.int64)
        last = np.concatenate([[CLASSES], cls[:-1]])
        last[starts] = CLASSES
        return last * CLASSES + cls

    none, seen = np.zeros(0), np.flatnonzero(count)
    m = with_shares(Model(of_class, row, before, none, {}, none, none, none), START * size + seen, count[seen])
    w = first_weights(np.random.default_rng(seed))
    w["bigram"] = bigram_table(summed(texts, (CLASSES + 2) * CLASSES, class_pairs).reshape(CLASSES + 2, CLASSES), np.bincount(of_class, weights=count, minlength=CLASSES))
    few = max(1, min(MOST_TASKS, n // (steps * WINDOWS_A_STEP)))
    rounds = max(1, min(ROUNDS, n // (few * WINDOWS_A_STEP * 16)))
    again = -(-steps * WINDOWS_A_STEP // n)
    some = texts.coalesce(few)
    for k in range(rounds):
        w = one_round(some, replace(m, w=w, share=none, after=none, back=none), k, rounds, again, rate, seed)
    common.drop_folder(spark, folder)
    return replace(m, w=w)


TOKENS = "tokens binary, sizes binary, n_tokens long, n_texts long, n_windows long"


def read_tokens(docs: DataFrame, path: str, block_chars: int = TOKEN_CHARS) -> DataFrame:
    """The tokens of all texts, a row for each block of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = Words(path), 0
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        seqs: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            flat, starts = words.flat(list(number))
            flat, starts = np.append(flat, np.int32(words.end)), np.append(starts, len(flat) + 1)
            seq = np.concatenate([np.append(x, np.int32(len(number))) for x in seqs])
            tokens, sizes = tokens_of(flat, starts, seq, np.array([len(x) + 1 for x in seqs]))
            columns = [[small(tokens)], [small(sizes)], [len(tokens)], [len(sizes)], [int((-(-sizes // STRIDE)).sum())]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i < 2 else pa.int64()) for i, c in enumerate(columns)], names=["tokens", "sizes", "n_tokens", "n_texts", "n_windows"])

        for frame in batches:
            for text in frame["text"].to_pylist():
                own = split(text)
                seqs.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
                size += len(text) if text else 1
                if size >= block_chars:
                    yield block()
                    size = 0
                    number.clear(), seqs.clear()
        if seqs:
            yield block()

    return docs.select("text").mapInArrow(read, TOKENS)


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, and starts and sizes of the texts, of the rows of ``read_tokens``."""
    for b in batches:
        for i in range(len(b)):
            n, k = b["n_tokens"][i].as_py(), b["n_texts"][i].as_py()
            own = large(b["sizes"][i].as_buffer(), k).astype(np.int64)
            yield large(b["tokens"][i].as_buffer(), n), np.cumsum(own) - own, own
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def summed(texts: DataFrame, cells: int, cells_of) -> np.ndarray:
    """How often each of ``cells`` numbers is among those that ``cells_of`` (tokens, starts) gives, over all texts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for tokens, starts, _ in token_rows(batches):
            total += np.bincount(cells_of(tokens, starts), minlength=cells)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    got = texts.mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def one_round(texts: DataFrame, m: Model, k: int, rounds: int, again: int, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Weights after steps on every ``rounds``-th window from the k-th, ``again`` times: the mean of all tasks by their windows."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, w, n = np.random.default_rng([seed, k]), {x: v.copy() for x, v in m.w.items()}, 0
        rows = token_rows(batches)
        rows = chain.from_iterable([list(rows)] * again) if again > 1 else rows  # only few documents are gone over again

        def parts() -> Iterator[tuple]:
            nonlocal n
            for tokens, starts, sizes in rows:
                owner, begin = windows(sizes)
                own = rng.permutation(np.arange(k, len(owner), rounds))
                n += len(own)
                for x in np.array_split(own, -(-len(own) // WINDOWS_A_STEP)) if len(own) else ():
                    yield targets(tokens, owner[x], begin[x], starts, sizes, m)

        adam(w, parts(), lambda t: rate * min(1, t / 50) * (1 - 0.95 * k / rounds))
        yield pa.RecordBatch.from_arrays([pa.array([packed(w).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["seq", "n"])

    got = [r for r in texts.mapInArrow(steps, "seq binary, n long").collect() if r["n"]]
    n = sum(r["n"] for r in got)
    return unpacked(sum(r["n"] / n * np.frombuffer(r["seq"], np.float32) for r in got), m.w) if n else m.w


def small(numbers: np.ndarray) -> bytes:
    """32-bit numbers compressed, for tables and shuffles."""
    return pa.compress(numbers.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def large(data, n: int) -> np.ndarray:
    """The ``n`` numbers of ``small``."""
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.int32) if n else np.zeros(0, np.int32)


KINDS = {"docs": 0, "words": 1, "ids": 2, "pairs": 3, "weights": 4}


def block_schema(ids: str) -> str:
    """Rows of a block: of each kind only some columns are filled."""
    return f"block long, doc_id {ids}, held_out boolean, n_tokens long, seq binary, word binary, k int, n long, pair long, kind int"


def id_field(ids: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ids))


def read_blocks(docs: DataFrame, model: Model, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Read (doc_id, text, held_out) rows block by block.

    A block gives its documents with their word numbers, its distinct words with their count in
    training documents, the token ids of its words, its pair counts, and its refined weights.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    none = np.zeros(0, np.float32)
    model = replace(model, share=none, after=none, back=none)  # blocks read no shares, and tasks need not hold their table
    kinds = {"block": pa.int64(), "doc_id": id_field(ids), "held_out": pa.bool_(), "n_tokens": pa.int64(), "seq": pa.binary(), "word": pa.binary(), "k": pa.int32(), "n": pa.int64(), "pair": pa.int64(), "kind": pa.int32()}

    def rows_of(kind: str, rows: int, block: int, **columns) -> pa.RecordBatch:
        columns |= {"block": np.full(rows, block), "kind": np.full(rows, KINDS[kind], np.int32)}
        arrays = [(c if isinstance(c := columns[name], pa.Array) else pa.array(c, t)) if name in columns else pa.nulls(rows, t) for name, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, no = Words(path), TaskContext.get().partitionId(), 0
        own_ids: list[pa.Array] = []
        held: list[bool] = []
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        seqs: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names, block = list(number), (part << 32) + no
            flat, starts = words.flat(names)
            flat, starts = np.append(flat, np.int32(words.end)), np.append(starts, len(flat) + 1)  # the end is the last word
            sizes = np.array([len(x) + 1 for x in seqs])
            yield rows_of("docs", len(seqs), block, doc_id=pa.concat_arrays(own_ids), held_out=held, n_tokens=sizes, seq=[small(x) for x in seqs])
            lengths = np.diff(starts)  # smaller than places
            yield rows_of("ids", 1, block, n_tokens=[len(lengths)], seq=[small(flat)], word=[small(lengths)])
            train_seqs = [x for x, h in zip(seqs, held, strict=True) if not h]
            count = np.bincount(np.concatenate([*train_seqs, np.zeros(0, np.int64)]), minlength=len(names))
            for i in range(0, len(names), 50_000):
                k = np.arange(i, min(i + 50_000, len(names)), dtype=np.int32)
                yield rows_of("words", len(k), block, word=names[i : i + 50_000], k=k, n=count[i : i + 50_000])
            if train_seqs:
                seq = np.concatenate([np.append(x, np.int32(len(names))) for x in train_seqs])
                tokens, per_text = tokens_of(flat, starts, seq, np.array([len(x) + 1 for x in train_seqs]))
                first = np.cumsum(per_text) - per_text
                pair, n = pairs_of(tokens, first, model.before)
                for i in range(0, len(pair), 100_000):
                    yield rows_of("pairs", len(pair[i : i + 100_000]), block, pair=pair[i : i + 100_000], n=n[i : i + 100_000])
                w, n_windows = refined(model, tokens, first, per_text)
                if n_windows:
                    yield rows_of("weights", 1, block, seq=[packed(w).astype(np.float32).tobytes()], n=[n_windows])

        for frame in batches:
            start = 0
            for i, (text, is_held) in enumerate(zip(frame["text"].to_pylist(), frame["held_out"].to_pylist(), strict=True)):
                own = split(text)
                seqs.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
                held.append(is_held)
                size += len(text) if text else 1
                if size >= block_chars:
                    own_ids.append(frame["doc_id"].slice(start, i + 1 - start))
                    yield from flush()
                    start, no, size = i + 1, no + 1, 0
                    own_ids.clear(), held.clear(), number.clear(), seqs.clear()
            if start < len(frame):
                own_ids.append(frame["doc_id"].slice(start))
        if seqs:
            yield from flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(blocks, block_schema(ids))


def tokens_of(flat: np.ndarray, starts: np.ndarray, seq: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts one after the other, and how many each has; ``seq`` has their word numbers, ``flat[starts[w]:starts[w + 1]]`` the ids of word w."""
    n = np.diff(starts)[seq]
    where = np.repeat(starts[seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return flat[where], np.add.reduceat(n, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


def averaged(weights: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the blocks' weights by their windows: one partial sum a partition reaches the driver, of at most 64."""
    size = len(packed(like))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for b in batches:
            for x, k in zip(b["seq"].to_pylist(), b["n"].to_pylist(), strict=True):
                total, n = total + k * np.frombuffer(x, np.float32), n + k
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["seq", "n"])

    got = weights.select("seq", "n").coalesce(64).mapInArrow(partial, "seq binary, n long").collect()
    n = sum(r["n"] for r in got)
    return unpacked(sum(np.frombuffer(r["seq"]) for r in got) / n, like) if n else like


def learned(seen: dict[str, DataFrame], model: Model) -> Model:
    """The model with what all blocks counted and refined."""
    pairs = seen["pairs"].groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toPandas()
    model = replace(model, w=averaged(seen["weights"], model.w))
    return with_shares(model, pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64))


def scored(docs: DataFrame, model: Model, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text, held_out) rows; what is not held out is learned from."""
    spark = docs.sparkSession
    ids = docs.schema["doc_id"].dataType.simpleString()
    folder = f"{common.shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    read_blocks(docs, model, path, block_chars).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/blocks")
    every = spark.read.schema(block_schema(ids)).parquet(f"{folder}/blocks")
    seen = {name: every.where(F.col("kind") == k) for name, k in KINDS.items()}
    model = learned(seen, model)

    # the count of each word over all training documents goes back to every block that has it
    same = Window.partitionBy("word")
    counts = seen["words"].select("block", "k", F.sum("n").over(same).alias("c"), F.max("block").over(same).alias("last"))  # a block has a word once
    counts.select(F.col("block").alias("home"), "k", "c", F.when(F.col("last") == F.col("block"), F.col("c")).alias("once")).write.option("compression", "zstd").parquet(f"{folder}/counts")
    counts = spark.read.schema("home long, k int, c long, once long").parquet(f"{folder}/counts")
    whole = counts.agg(F.sum("once").alias("n"), F.count_if(F.col("once") > 0).alias("v")).collect()[0]
    ends = seen["docs"].where(~F.col("held_out")).count()
    n, v = (whole["n"] or 0) + ends, (whole["v"] or 0) + (ends > 0)

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(pa.compute.equal(left["kind"], KINDS["docs"]))
        ids_row = left.filter(pa.compute.equal(left["kind"], KINDS["ids"])).to_pylist()[0]
        starts = np.concatenate([[0], np.cumsum(large(ids_row["word"], ids_row["n_tokens"]), dtype=np.int64)])
        flat = large(ids_row["seq"], int(starts[-1]))
        c = np.zeros(len(starts) - 1, np.int64)
        c[right["k"].to_numpy()] = right["c"].to_numpy()
        c[-1] = ends
        seqs = [np.append(large(x.as_buffer(), k - 1), np.int32(len(c) - 1)) for x, k in zip(own["seq"], own["n_tokens"].to_pylist(), strict=True)]
        log, known = np.log10(c + 1.0) - np.log10(n + v + 1), c > 0
        columns = {
            "doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": own["n_tokens"], "n_known": [int(known[x].sum()) for x in seqs], "train_tokens": [n] * len(seqs),
            "base_score": [float(log[x].sum()) for x in seqs], "score": log_probabilities(flat, starts, np.concatenate(seqs), np.array([len(x) for x in seqs]), model),
        }
        return pa.table(columns)

    left = every.where(F.col("kind").isin(KINDS["docs"], KINDS["ids"])).select("block", "kind", "doc_id", "held_out", "n_tokens", "seq", "word")
    schema = f"doc_id {ids}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = common.cut(left.groupBy("block").cogroup(counts.select("home", "k", "c").groupBy("home")).applyInArrow(score_block, schema))
    common.drop_folder(spark, folder)
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a model and counts of those outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", (common.fold("doc_id", 7) == 2).alias("held_out"))
    path = tokenizer_path()
    return scored(docs, fit(docs.where("NOT held_out"), path), path)
