"""Language-model scores of whole documents by a gated recurrent network with a class-factored softmax.

Tokens are words and one end for each text. The most frequent words of the training texts are the network's vocabulary, in
classes of equal size by rank; all other words form one rare class, inside which a word has its smoothed count. So
P(word) = P(class | state) * P(word | class, state), and the probabilities of all words, known or not, sum to one. Many classes come in
groups, P(class) = P(group) * P(class | group). The output biases start at the corpus counts: an untrained network scores exactly as the
unigram base does.

Training: truncated backpropagation in numpy on the executors, in rounds that share out all training texts. Each task trains on its part of
a round's texts with one Adam, and the weights are averaged by tokens; so the work grows with the corpus and what comes to the driver is
one set of weights. The network's vocabulary grows with the corpus (see grown): a limit, since words beyond it share one class and are
told apart by their counts alone. Counts are taken over all training texts. Scoring: whole texts, many side by side, the state carried
across windows.

Scale: words are cut, counted and coded in Arrow, a text once; the table of codes is what training and scoring read. Counts are summed in
tasks (a bounded table that is flushed) before they are shuffled. The `cache` most frequent words, of at most MAX_WORD bytes, are broadcast,
so frequent words never meet in a shuffle; only the others are joined with the counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from copy import copy
from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fold_of, narrow, slices, written

#: The end of a text, as a word: no word is empty.
END = b""
SMOOTH = 0.1
MAX_WORD = 64
#: So many classes and more come in groups.
GROUPED = 64
_LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Shape:
    classes: int = 32
    per_class: int = 64
    embed: int = 24
    hidden: int = 32

    @property
    def words(self) -> int:
        return self.classes * self.per_class

    @property
    def per_group(self) -> int:
        """Classes in a group: about as many as there are groups. Few classes are groups of their own."""
        return isqrt(self.classes) if self.classes >= GROUPED else 1

    @property
    def groups(self) -> int:
        return -(-self.classes // self.per_group)


def grown(tokens: int, most: int) -> Shape:
    """The shape for a corpus of so many tokens: as many words as the square root of the tokens, up to `most`, in about as many classes as
    a class has words, so that the output's cost, that of a class's words, grows with the fourth root of the tokens."""
    s = Shape()
    words = max(s.words, min(isqrt(tokens), most))
    per_class = max(s.per_class, isqrt(words))
    return replace(s, classes=words // per_class, per_class=per_class)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, each text's followed by END, and how many tokens each text has. A word of more than MAX_WORD bytes goes by
    its digest behind a byte that UTF-8 lacks: so all words are short, and a frequent long one is in the lexicon as any other."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().cast(pa.binary())
    size, parts = pc.binary_length(flat).to_numpy(), pc.list_value_length(lists).to_numpy()
    own = np.flatnonzero(size)  # splitting leaves empty words at a text's ends
    counts = np.bincount(np.repeat(np.arange(len(parts)), parts)[own], minlength=len(parts)) + 1
    long = np.flatnonzero(size > MAX_WORD)
    names = [END, *(b"\xff" + hashlib.sha256(flat[int(k)].as_py()).digest() for k in long)]
    place = np.arange(len(flat))
    place[long] = len(flat) + 1 + np.arange(len(long))
    at = np.full(counts.sum(), len(flat))
    inner = np.ones(len(at), bool)
    inner[np.cumsum(counts) - 1] = False
    at[inner] = place[own]
    return pa.concat_arrays([flat, pa.array(names, pa.binary())]).take(pa.array(at)), counts


def word_counts(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, c) over whole texts, END included. A task's table is sent on when it has `most` words."""

    def summed(parts):
        return pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks().to_batches()

    def run(batches):
        parts, rows = [], 0
        for batch in slices(batches, 1 << 14, 16 << 20):
            found = pc.value_counts(tokens(batch.column("text"))[0])
            parts.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["word", "c"]))
            rows += len(found)
            if rows >= most:
                parts = summed(parts)
                rows = sum(p.num_rows for p in parts)
                if rows >= most // 2:
                    yield from parts
                    parts, rows = [], 0
        if parts:
            yield from summed(parts)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The `most` words of highest count, the first by order of bytes among equals. Words whose count has fewer binary digits than any of these
    are left out before the sort, which ends in one task; the driver gets one number for each length."""
    have, least = 0, 1
    for digits, n in sorted(counts.groupBy(F.length(F.bin("c"))).agg(F.count("*")).collect(), reverse=True):
        have, least = have + n, 1 << (digits - 1)
        if have >= most:
            break
    return counts.filter(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(most)


class Lexicon:
    """The frequent words with their counts, and the totals of all training tokens."""

    def __init__(self, ranked: list[bytes], counts: np.ndarray, total: int, distinct: int, shape: Shape):
        self.words = pa.array(ranked, pa.binary())
        self.counts, self.total, self.distinct, self.shape = counts, total, distinct, shape
        self.n_words = min(shape.words, len(ranked))  # of the network
        self.rare_total = total - int(counts[: self.n_words].sum())
        self.log_all = np.log(total + SMOOTH * (distinct + 1))
        self.log_rare = np.log(self.rare_total + SMOOTH * (distinct - self.n_words + 1))

    def bare(self) -> Lexicon:
        """What the network needs of the lexicon: without the words' texts."""
        out = copy(self)
        out.words, out.counts = None, self.counts[: self.n_words]
        return out

    def ranks(self, words: pa.Array) -> np.ndarray:
        """The rank of each word, -1 where the lexicon has none."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)


class Network:
    """Weights by name. Class c holds the words of ranks c * per_class on, a group the classes next to each other. A word is chosen by its
    group, class and rank in it: "c", "m" (only if groups have several classes) and "o". Beside the groups stands that of all rare words."""

    def __init__(self, lex: Lexicon, seed: int = 3):
        s, rng = lex.shape, np.random.default_rng(seed)
        self.shape = s
        mass = np.full(s.words, -30.0)
        mass[: lex.n_words] = np.log(lex.counts[: lex.n_words] + SMOOTH)
        mass = mass.reshape(s.classes, s.per_class) - lex.log_all
        by_class = np.full(s.groups * s.per_group, -30.0 - lex.log_all)
        by_class[: s.classes] = _log_sum(mass)
        by_class = by_class.reshape(s.groups, s.per_group)
        self.w = {
            "e": rng.normal(0, 0.1, (s.words + 1, s.embed)), "wx": rng.normal(0, s.embed**-0.5, (s.embed, 3 * s.hidden)), "b": np.zeros(3 * s.hidden), "u": rng.normal(0, s.hidden**-0.5, (s.hidden, 3 * s.hidden)),
            "c": np.zeros((s.hidden, s.groups + 1)), "cb": np.append(_log_sum(by_class), lex.log_rare - lex.log_all), "o": np.zeros((s.classes, s.hidden, s.per_class)), "ob": mass,
        }
        if s.per_group > 1:
            self.w |= {"m": np.zeros((s.groups, s.hidden, s.per_group)), "mb": by_class}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.w.values()])

    def load(self, x: np.ndarray) -> Network:
        at = 0
        for k, v in self.w.items():
            self.w[k] = x[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def gates(self, name: str) -> np.ndarray:
        """The weights of that name for each of the gates z, r and of the candidate."""
        w = self.w[name]
        return np.ascontiguousarray(w.reshape(-1, 3, self.shape.hidden).transpose(1, 0, 2))

    def inputs(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What each word adds to each gate."""
        return self.w["e"][ids] @ self.gates("wx") + self.gates("b")

    def steps(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool = False, table: np.ndarray | None = None):
        """States before each of the tokens x (time by lane), the state after them, and with keep the gates z, r, c and the candidate's
        part of h @ u, each time by lane. table: inputs(), if at hand. Each gate has arrays of its own, without gaps."""
        n, u = self.shape.hidden, self.gates("u")
        table = self.inputs() if table is None else table
        states, kept = np.empty((*x.shape, n), h.dtype), np.empty((len(x) if keep else 0, 4, x.shape[1], n), h.dtype)
        new = reset.any(axis=1)
        for t in range(len(x)):
            if new[t]:
                h = np.where(reset[t][:, None], h.dtype.type(0), h)
            states[t] = h
            a, g = table.take(x[t], axis=1), h @ u
            zr = np.add(a[:2], g[:2], out=kept[t, :2] if keep else None)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = np.multiply(zr[1], g[2], out=kept[t, 2] if keep else None)
            c += a[2]
            np.tanh(c, out=c)
            if keep:
                kept[t, 3] = g[2]
            h = h - c
            h *= zr[0]
            h += c
        return states, h, kept.transpose(1, 0, 2, 3) if keep else None

    def output(self, h: np.ndarray, y: np.ndarray, grad: bool = False, rows: int = 2048):
        """Natural log-probability of each token y (rank, or words for rare, without the share inside the rare class), and with grad
        the gradients of the sum of negated ones; those of classes and of groups for the ones in use, which are its `used` by name."""
        s, w = self.shape, self.w
        order = np.argsort(y.astype(np.uint16) if s.words < 1 << 16 else y, kind="stable")  # by word, and so by class and by group
        h, y = h.take(order, axis=0), y[order]
        n = int(np.searchsorted(y, s.words))
        cls, word = np.divmod(y[:n], s.per_class)
        group, of_group = np.divmod(cls, s.per_group)
        top = np.append(group, np.full(len(y) - n, s.groups))
        lp, dh, g = np.empty(len(y)), np.empty_like(h) if grad else None, {}
        if grad:
            g = {"c": np.zeros_like(w["c"]), "cb": np.zeros_like(w["cb"]), "used": {}}
        for at in range(0, len(y), rows):
            part = slice(at, at + rows)
            p, lp[part] = _softmax(h[part], w["c"], w["cb"], top[part], grad)
            if grad:
                np.matmul(p.T, w["c"].T, out=dh[part])
                g["c"] += (p @ h[part]).T
                g["cb"] += p.sum(axis=1)
        for name, node, choice in (("m", group, of_group), ("o", cls, word)) if n else ():
            if name in w:
                inner, back, own = _softmax_by_node(h[:n], node, choice, w[name], w[name + "b"], grad)
                lp[:n] += inner
                if grad:
                    dh[:n] += back
                    g[name], g[name + "b"], g["used"][name] = own
        out, back = np.empty_like(lp), np.empty_like(h) if grad else None
        out[order] = lp
        if grad:
            back[order] = dh
        return out, back, g

    def gradient(self, x: np.ndarray, reset: np.ndarray, live: np.ndarray, h0: np.ndarray):
        """Backpropagation through one window; the state that comes in counts as given. Returns the gradients and the state that goes out."""
        g, rows, h = self.sparse_gradient(x, reset, live, h0)
        for k, at in rows.items():
            whole = np.zeros_like(self.w[k])
            whole[at] = g[k]
            g[k] = whole
        return g, h

    def sparse_gradient(self, x: np.ndarray, reset: np.ndarray, live: np.ndarray, h0: np.ndarray):
        """As gradient, but of the words and classes in use alone; rows has their places by name."""
        n, w = self.shape.hidden, self.w
        ids, own = np.unique(x, return_inverse=True)
        own = own.reshape(x.shape)
        hp, h, (z, r, c, gc) = self.steps(own, reset, h0, keep=True, table=self.inputs(ids))
        if live.all():
            _, dh_out, g = self.output(hp.reshape(-1, n), x.reshape(-1), grad=True)
        else:
            on, dh_out = live.reshape(-1), np.zeros((x.size, n), h0.dtype)
            _, dh_out[on], g = self.output(hp.reshape(-1, n)[on], x.reshape(-1)[on], grad=True)
        dh_out = dh_out.reshape(*x.shape, n)
        # of what goes into z and r, of the candidate's part of h @ u, and of what goes into the candidate
        da, dh, u_back = np.empty((4, *x.shape, n), h0.dtype), np.zeros_like(h0), np.ascontiguousarray(self.gates("u").transpose(0, 2, 1))
        new, one, two, three = reset.any(axis=1), np.empty_like(h0), np.empty_like(h0), np.empty((3, *h0.shape), h0.dtype)
        for t in range(len(x) - 1, -1, -1):  # one lane's arrays are small enough for the processor's cache: no temporaries of whole windows
            zt, rt, ct = z[t], r[t], c[t]
            np.subtract(1, zt, out=one)
            one *= dh
            np.subtract(hp[t], ct, out=two)
            two *= zt
            np.multiply(one, two, out=da[0, t])
            ct *= ct
            np.subtract(1, ct, out=ct)
            np.multiply(one, ct, out=da[3, t])
            np.multiply(da[3, t], rt, out=da[2, t])
            np.subtract(1, rt, out=two)
            two *= gc[t]
            np.multiply(da[2, t], two, out=da[1, t])
            dh *= zt
            np.matmul(da[:3, t], u_back, out=three)
            for v in three:
                dh += v
            dh += dh_out[t]
            if new[t]:
                dh[reset[t]] = 0
        flat, places, in_use = da.reshape(4, -1, n), own.reshape(-1), g.pop("used")
        wx, e_t, h_t = self.gates("wx"), w["e"].take(x.reshape(-1), axis=0).T, hp.reshape(-1, n).T
        to_e = sum(wx[k] @ flat[j].T for k, j in enumerate((0, 1, 3)))
        by_word = np.stack([np.bincount(places, v, len(ids)) for v in to_e], 1).astype(h0.dtype)
        g |= {"u": np.concatenate([h_t @ flat[k] for k in (0, 1, 2)], 1), "wx": np.concatenate([e_t @ flat[k] for k in (0, 1, 3)], 1), "b": _sum(flat[[0, 1, 3]]).reshape(-1), "e": by_word}
        return g, {"e": ids} | in_use | {k + "b": v for k, v in in_use.items()}, h


def _sum(p: np.ndarray) -> np.ndarray:
    """Sums over the last axis but one, which a product forms faster than a sum."""
    return np.ones(p.shape[-2], p.dtype) @ p


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def _softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, y: np.ndarray, grad: bool):
    """Of the outputs h @ w + bias (choice by row of h, as there are few choices): with grad the gradients of the sum of the negated
    log-probabilities of y, and these log-probabilities."""
    e = w.T @ h.T
    e += bias[:, None]
    at = y, np.arange(len(y))
    own = e[at].astype(np.float64)
    np.exp(e, out=e)
    total = e.sum(axis=0)
    if not (np.isfinite(total).all() and total.all()):  # beyond single precision: from the largest on
        e = w.T @ h.T + bias[:, None]
        top = e.max(axis=0)
        own -= top
        np.exp(e - top, out=e)
        total = e.sum(axis=0)
    if grad:
        e *= np.reciprocal(total)
        e[at] -= 1
    return e, own - np.log(total.astype(np.float64))


def _softmax_by_node(h: np.ndarray, node: np.ndarray, y: np.ndarray, w: np.ndarray, bias: np.ndarray, grad: bool):
    """Of rows in order of their node: the log-probability of y among the node's choices, and with grad the gradients of the sum of
    negated ones by h, and by w and bias for the nodes in use, which are the third of these. Only the products go node by node."""
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    used, bounds = node[starts], [*starts.tolist(), len(node)]
    parts = [(k, slice(a, b)) for k, a, b in zip(used.tolist(), bounds, bounds[1:], strict=False)]
    e = np.empty((len(node), w.shape[2]), h.dtype)

    def outputs():
        for k, of in parts:
            part = np.matmul(h[of], w[k], out=e[of])
            part += bias[k]

    outputs()
    flat, at = e.reshape(-1), np.arange(len(node)) * w.shape[2] + y
    own = flat.take(at).astype(np.float64)
    np.exp(e, out=e)
    total = e @ np.ones(w.shape[2], h.dtype)
    if not (np.isfinite(total).all() and total.all()):  # as in _softmax
        outputs()
        top = e.max(axis=1)
        own -= top
        e -= top[:, None]
        np.exp(e, out=e)
        total = e.sum(axis=1)
    lp = own - np.log(total.astype(np.float64))
    if not grad:
        return lp, None, None
    flat[at] -= total
    share = np.reciprocal(total)  # of it the rows of h and of its gradient take less time than those of e
    hs, dh = h * share[:, None], np.empty_like(h)
    dw, dbias = np.empty((len(used), *w.shape[1:]), h.dtype), np.empty((len(used), w.shape[2]), h.dtype)
    for j, (k, of) in enumerate(parts):
        np.matmul(e[of], w[k].T, out=dh[of])
        np.matmul(hs[of].T, e[of], out=dw[j])
        np.matmul(share[of], e[of], out=dbias[j])
    dh *= share[:, None]
    return lp, dh, (dw, dbias, used)


def lanes(lengths: list[int], width: int) -> list[list[int]]:
    """Texts dealt over lanes, the longest first, each to the lane that is shortest so far."""
    out, filled = [[] for _ in range(width)], np.zeros(width, np.int64)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        lane = int(filled.argmin())
        out[lane].append(k)
        filled[lane] += lengths[k]
    return out


def windows(codes: list[np.ndarray], limit: int, width: int, steps: int):
    """Windows (lanes in use, tokens, resets, owner of each place or -1) of `steps` by lanes over all texts; `limit` fills places
    without a token. Memory is linear in the tokens, whatever the longest text."""
    dealt = [k for k in lanes([len(c) for c in codes], min(width, max(1, len(codes)))) if k]
    order = [k for lane in dealt for k in lane]
    length = np.array([len(codes[k]) for k in order], np.int64)
    tokens = np.concatenate([np.empty(0, np.int64), *(codes[k] for k in order)])
    owners, first = np.repeat(np.array(order, np.int64), length), np.zeros(len(tokens), bool)
    first[(np.cumsum(length) - length)[length > 0]] = True
    size = np.array([sum(len(codes[k]) for k in lane) for lane in dealt], np.int64)
    start, longest = np.cumsum(size) - size, int(size.max(initial=0))
    for at in range(0, longest, steps):
        some = size > at
        now = np.arange(at, min(at + steps, longest))[:, None]
        inside = now < size[some]
        place = np.where(inside, start[some] + now, 0)
        yield some, np.where(inside, tokens[place], limit), first[place] & inside, np.where(inside, owners[place], -1)


def score_texts(net: Network, codes: list[np.ndarray], width: int = 256, steps: int = 48) -> np.ndarray:
    """The network's log-probability of each whole text, rare words counting as their class."""
    limit, total, h, table = net.shape.words, np.zeros(len(codes)), None, net.inputs()
    for some, x, reset, owner in windows(codes, limit, width, steps):
        h = np.zeros((len(some), net.shape.hidden), np.float32) if h is None else h
        states, h[some], _ = net.steps(x, reset, h[some], table=table)
        on = owner.reshape(-1) >= 0
        lp, _, _ = net.output(states.reshape(-1, net.shape.hidden)[on], x.reshape(-1)[on])
        total += np.bincount(owner.reshape(-1)[on], lp, len(codes))
    return total


def stream(codes: list[np.ndarray], limit: int, width: int):
    """All texts end to end, cut into `width` lanes of one length (time by lane): tokens, where a text or lane begins, and which places
    are tokens. Only training reads texts so: a text that a lane's end cuts goes on from a new state."""
    tokens = np.concatenate([np.empty(0, np.int64), *codes])
    first = np.zeros(len(tokens), bool)
    sizes = np.array([len(c) for c in codes], np.int64)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    length = -(-len(tokens) // width)
    pad = length * width - len(tokens)
    x, reset = np.pad(tokens, (0, pad), constant_values=limit), np.pad(first, (0, pad))
    x, reset = (np.ascontiguousarray(v.reshape(width, length).T) for v in (x, reset))
    reset[:1] = True
    return x, reset, np.ascontiguousarray((np.arange(length * width) < len(tokens)).reshape(width, length).T)


class Adam:
    """Steps of Adam on a network, in place. Words and classes outside a window keep their weights and moments in it."""

    def __init__(self, net: Network, rate: float = 0.02, fade: int = 200):
        self.net, self.rate, self.fade, self.step = net, rate, fade, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}

    def __call__(self, g: dict, rows: dict, tokens: int):
        """The rate rises over the first steps and falls with the root of their number after `fade`."""
        self.step += 1
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())) / tokens
        scale = min(1.0, 1.0 / max(norm, 1e-12)) / tokens
        fix = self.rate * min(1.0, self.step / 5, (self.fade / self.step) ** 0.5) * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, v in g.items():
            at, state = rows.get(k), (self.net.w[k], *self.moments[k])
            if at is None or len(at) == len(state[0]):
                self._update(v, *state, scale, fix)
                continue
            own = [x.take(at, axis=0) for x in state]
            self._update(v, *own, scale, fix)
            for x, part in zip(state, own, strict=True):
                x[at] = part

    @staticmethod
    def _update(g, w, first, second, scale, fix):
        """Weights and moments in place; g is used up."""
        g *= scale
        first *= 0.9
        first += 0.1 * g
        g *= g
        g *= 0.001
        second *= 0.999
        second += g
        root = np.sqrt(second, out=g)
        root += 1e-7
        np.divide(first, root, out=root)
        root *= fix
        w -= root


def train_texts(net: Network, codes: list[np.ndarray], adam: Adam | None = None, width: int = 512, steps: int = 16) -> int:
    """One pass over the texts, in place; the number of tokens. Few tokens go in narrower lanes, so that there are steps to learn in."""
    adam, tokens = adam or Adam(net), sum(map(len, codes))
    x, reset, live = stream(codes, net.shape.words, max(1, min(width, tokens // (32 * steps))))
    h = np.zeros((x.shape[1], net.shape.hidden), np.float32)
    for at in range(0, len(x), steps):
        some = slice(at, at + steps)
        g, rows, h = net.sparse_gradient(x[some], reset[some], live[some], h)
        adam(g, rows, int(live[some].sum()))
    return tokens


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of integer lists, without a Python object for each number."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _coder(shared):
    """Texts as codes of the network, with what needs no network: known words, their logarithms, and the words that the lexicon lacks."""

    def run(batches):
        lex = shared.value
        logs, limit = np.append(np.log(lex.counts + SMOOTH), 0.0), lex.shape.words
        for batch in slices(batches, 1 << 14, 16 << 20):
            words, n = tokens(batch.column("text"))
            rank = lex.ranks(words)
            starts, known = np.cumsum(n) - n, rank >= 0
            value = logs[rank]  # the last is that of the rank -1
            rare = rank >= lex.n_words
            ends = lambda counts: pa.array(np.cumsum([0, *counts]), pa.int32())
            codes = pa.ListArray.from_arrays(ends(n), pa.array(np.where(known & ~rare, rank, limit).astype(np.int32)))
            others = pa.ListArray.from_arrays(ends(np.add.reduceat(~known, starts, dtype=np.int64)), words.filter(pa.array(~known)))
            sums = {"known": known.astype(np.int64), "base": value, "inner": np.where(rare, value - lex.log_rare, 0.0)}
            out = {"doc_id": batch.column("doc_id"), "codes": codes, **{k: pa.array(np.add.reduceat(v, starts)) for k, v in sums.items()}, "others": others}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _trainer(shared, segment: int):
    def run(batches):
        lex, start = shared.value
        net, seen = Network(lex).load(start), 0
        adam = Adam(net)
        for batch in _gathered(batches):
            seen += train_texts(net, _lists(batch.column("codes")), adam)
        x = net.vector() if seen else start[:0]
        parts = [x[k : k + segment] for k in range(0, len(x), segment)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "tokens": pa.array([float(seen)] * len(parts)), "x": pa.array(parts, pa.list_(pa.float32()))})

    return run


def _averaged(batches):
    """Each part of the weights, averaged over tasks by their tokens."""
    total, weight = {}, Counter()
    for batch in slices(batches, 512):
        for part, tokens, x in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), batch.column("x"), strict=True):
            v = x.values.to_numpy() * np.float64(tokens)
            total[part] = total[part] + v if part in total else v
            weight[part] += tokens
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "x": pa.array([(v / weight[k]).astype(np.float32) for k, v in total.items()], pa.list_(pa.float32()))})


def _gathered(batches, most: int = 8 << 20):
    """Batches of whole rows joined to about `most` bytes: the more texts run side by side, the fewer steps a long one takes alone."""
    parts, size = [], 0
    for batch in slices(batches):
        parts, size = [*parts, batch], size + batch.nbytes
        if size >= most:
            yield pa.concat_batches(parts)
            parts, size = [], 0
    if parts:
        yield pa.concat_batches(parts)


def _scorer(shared):
    def run(batches):
        lex, weights = shared.value
        net = Network(lex).load(weights)
        for batch in _gathered(batches):
            model = score_texts(net, _lists(batch.column("codes")))
            rest = {c: batch.column(c) for c in batch.schema.names if c != "codes"}
            yield pa.RecordBatch.from_pydict(rest | {"model": pa.array(model, pa.float64())})

    return run


def fit(coded: DataFrame, lex: Lexicon, *, rounds: int = 2, segment: int = 512) -> np.ndarray:
    """Weights after rounds of local training and averaging over all texts of `coded` (row, codes), each round with texts of its own."""
    spark, weights = coded.sparkSession, Network(lex).vector()
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((lex.bare(), weights))
        texts = coded.filter(F.pmod(F.xxhash64("row", F.lit("train")), F.lit(rounds)) == r)
        got = texts.select("codes").mapInArrow(_trainer(shared, segment), "part int, tokens double, x array<float>")
        # so many tasks that each reads a share of the weights that does not grow with them, of every trainer
        mean = got.repartition(-(-len(weights) // (32 * segment)), "part").mapInArrow(_averaged, "part int, x array<float>").toArrow()
        if mean.num_rows:
            weights = np.empty_like(weights)
            for k, x in zip(mean["part"].to_pylist(), mean["x"], strict=True):
                weights[k * segment : (k + 1) * segment] = x.values.to_numpy()
        shared.unpersist()
    return weights


def document_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 10, cache: int = 1 << 19, shape: Shape | None = None, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of probabilities).

    Texts whose crc32(id) mod `folds` is not 0 are learnt from; a null id counts as empty text. A null text is empty: its one token is
    the end. Repeated rows count and are scored each. If there is nothing to learn from, all words are unknown and both scores are
    those of the smoothing alone. Other columns are ignored.
    """
    texts, spark = narrow(docs, id_col, text_col), docs.sparkSession
    counts = written(word_counts(texts.filter(fold_of("doc_id", folds) != 0)))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ranked = most_frequent(counts, cache).toArrow()
    lex = Lexicon(ranked["word"].to_pylist(), ranked["c"].to_numpy().astype(np.float64), total, distinct, shape or grown(total, cache))
    shared = spark.sparkContext.broadcast(lex)
    id_type = dict(texts.dtypes)["doc_id"]
    coded = texts.mapInArrow(_coder(shared), f"doc_id {id_type}, codes array<int>, known long, base double, inner double, others array<binary>")
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()))
    weights = spark.sparkContext.broadcast((lex.bare(), fit(coded.filter(fold_of("doc_id", folds) != 0), lex, rounds=rounds)))
    whole = coded.select("row", "doc_id", F.size("codes").cast("long").alias("n_tokens"), "known", "base", "inner", "codes")
    rows = whole.mapInArrow(_scorer(weights), f"row long, doc_id {id_type}, n_tokens long, known long, base double, inner double, model double")
    rare = coded.select("row", F.explode("others").alias("word")).join(counts, "word", "left")
    log_c = F.log(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    rare = rare.groupBy("row").agg(F.count("*").alias("n_other"), F.count("c").alias("more"), F.sum(log_c).alias("log_c"))
    rest = rows.join(rare, "row", "left").na.fill(0, ["n_other", "more"]).na.fill(0.0, ["log_c"])
    base = (F.col("base") + F.col("log_c") - F.col("n_tokens") * F.lit(float(lex.log_all))) / _LOG10
    score = (F.col("model") + F.col("inner") + F.col("log_c") - F.col("n_other") * F.lit(float(lex.log_rare))) / _LOG10
    return rest.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
