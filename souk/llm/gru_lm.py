"""Document log-likelihoods under a gated recurrent language model.

Tokens are the words of the lower-cased text (ASCII white space separates them,
only A-Z are lowered) and one end mark. All training tokens are counted with
Spark; the ``VOCABULARY`` most frequent ones are the words of the recurrent model,
any other token is its "rare" word, spelled by the add-one unigram estimate:

    P(w | history) = P(word of w | history)                       if w is a word of the model
                   = P(rare | history) * b(w) / (1 - sum of b over the model's words)   else
    b(w) = (c(w) + 1) / (N + V + 1)

which is a probability distribution over the V counted tokens and one unseen one.

The model is a GRU with a class-factored softmax (words are binned by the square
root of their frequency; P = P(class) * P(word | class)), trained in numpy by
truncated backpropagation with Adam over *all* training rows: they are dealt into
``ROUNDS`` rounds, in a round every task trains a copy of the model on all tokens of
its rows, and the copies are averaged by their tokens (:func:`train_all`). A start for
the first round is trained on the driver (``SAMPLE_DOCS`` texts in expectation, of each
at most ``SAMPLE_CHARS`` characters, ``SAMPLE_TOKENS`` tokens in all). A document starts
with a zero state and the end mark as input, however long it is; scoring carries the
state from window to window through the whole document, many documents in step.

Counts of the ``HEAD`` most frequent tokens travel with the model (a fixed bound);
every other token of every document is joined with the full table of counts,
as (row, token, times) rows, so nothing that grows with the corpus is broadcast.

Cases: null text counts as empty (only the end mark); ids may repeat or be null
(rows are numbered inside); very long texts cost time in proportion to length;
with no training row N = V = 0, no word is known and score equals base_score;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import crc_of_id, held, ship, small_batches
from souk.sources.staging import stage

END = "\n"                   # no word contains it
VOCABULARY = 2048
HEAD = 150_000
SAMPLE_DOCS = 800
SAMPLE_TOKENS = 400_000
SAMPLE_CHARS = 20_000        # characters of one text that the driver's start takes
HIDDEN = 16
CLASSES = 40
EPOCHS = 3
STREAMS, WINDOW = 32, 24     # truncated backpropagation: parallel streams, steps per window
ROUNDS = 2                   # every training row is in one round; models are averaged after each
TASK_STREAMS = 256           # parallel streams in a task
TASK_TOKENS = 500_000        # tokens (whole documents) laid out at a time in a task
TASK_RATE = 0.004            # of Adam, in the first round; falls to half of it in the last
MODELS = 32                  # models averaged in one step
GROUP_TOKENS, GROUP_DOCS = 3_000_000, 20_000
FLUSH = 60_000_000           # bytes of tokens gathered in a task before they are counted and handed on
BLOCK = 16_384               # tokens whose probabilities are computed at a time


def tokens(text: str | None) -> list[str]:
    """Words and the end mark. bytes.lower and bytes.split know ASCII only, as the
    definition asks; str.split would also cut at other white space."""
    words = text.encode().lower().split() if text else []
    out = b"\n".join(words).decode().split("\n") if words else []
    out.append(END)
    return out


def words_of(texts):
    """An Arrow array of texts as (all words of all texts, where each text's words end):
    the words of :func:`tokens` without the end marks, cut by Arrow instead of one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    found = cut.flatten()
    filled = pc.not_equal(found, "")                                     # a text's ends may give empty ones
    upto = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return found.filter(filled), upto[cut.offsets.to_numpy()[1:]]


def with_ends(codes: np.ndarray, cuts: np.ndarray, end: int) -> np.ndarray:
    """The words' codes with one end mark after each text."""
    out = np.full(len(codes) + len(cuts), end, np.int32)
    inside = np.ones(len(out), bool)
    inside[cuts + np.arange(len(cuts))] = False
    out[inside] = codes
    return out


def codes_of(words, table) -> np.ndarray:
    """Places of the words in the table, -1 where they are not in it."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy()


# -- the model -----------------------------------------------------------------

@dataclass
class Gru:
    """Parameters; words are ordered so that a class is a range of words."""
    embed: np.ndarray            # (words, 3H): input part of update, reset and candidate
    recur: np.ndarray            # (H, 3H)
    to_class: np.ndarray         # (H, C)
    class_bias: np.ndarray
    to_word: np.ndarray          # (words, H)
    word_bias: np.ndarray
    cuts: np.ndarray             # first word of each class, and the number of words

    @property
    def hidden(self) -> int:
        return self.recur.shape[0]

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.to_class, self.class_bias, self.to_word, self.word_bias]


def class_cuts(counts: np.ndarray, classes: int) -> np.ndarray:
    """Ranges of words (most frequent first) of about equal square-root frequency."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    inner = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate(([0], np.minimum(inner, len(counts)), [len(counts)])))


def new_model(counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 5) -> Gru:
    rng = np.random.default_rng(seed)
    cuts = class_cuts(counts, classes)
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    freq = counts + 1.0
    mass = np.add.reduceat(freq, cuts[:-1])
    return Gru(small(len(counts), 3 * hidden), (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
               small(hidden, len(cuts) - 1), np.log(mass / mass.sum()).astype(np.float32),
               small(len(counts), hidden), np.log(freq / freq.sum()).astype(np.float32), cuts)


# States and logits are laid out with the places in a text last: (hidden, places) and
# (words, places). numpy's loops then run over long contiguous rows.

def _gates(fed: np.ndarray, recur: np.ndarray, h: np.ndarray):
    """One step of the recurrence from the inputs' part (3H, places) and the states (H, places)."""
    hid = len(h)
    u = recur @ h
    gates, un = u[:2 * hid], u[2 * hid:]
    gates += fed[:2 * hid]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:hid], gates[hid:]
    n = r * un
    n += fed[2 * hid:]
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, z, r, n, un


def _softmax(weights: np.ndarray, bias: np.ndarray, states: np.ndarray):
    """Exponentials (words, places) of the logits less their maximum, their sums, and the logits less it."""
    x = weights @ states
    x += bias[:, None]
    x -= x.max(axis=0)
    e = np.exp(x)
    return e, e.sum(axis=0), x


def _by_class(m: Gru, words: np.ndarray):
    """Classes of the words, the order that sorts them by class, and the classes' edges in it."""
    kind = np.repeat(np.arange(len(m.cuts) - 1, dtype=np.min_scalar_type(len(m.cuts))), np.diff(m.cuts))[words]
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    return kind, order, np.searchsorted(kind, np.arange(len(m.cuts)))


def log_probs(m: Gru, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log probability of each word given the state before it, a row of ``states``."""
    kind, order, edge = _by_class(m, words)
    states, words, place = states.T.take(order, axis=1), words[order], np.arange(len(words))
    _, total, x = _softmax(m.to_class.T, m.class_bias, states)
    lp = x[kind, place].astype(np.float64) - np.log(total)
    for k in range(len(m.cuts) - 1):
        rows, a, b = slice(edge[k], edge[k + 1]), m.cuts[k], m.cuts[k + 1]
        if edge[k] < edge[k + 1] and b - a > 1:
            _, total, x = _softmax(m.to_word[a:b], m.word_bias[a:b], states[:, rows])
            lp[rows] += x[words[rows] - a, place[:x.shape[1]]] - np.log(total)
    out = np.empty(len(words))
    out[order] = lp
    return out


def _flat(x: np.ndarray) -> np.ndarray:
    """(steps, rows, streams) as (rows, places)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def _gradients(m: Gru, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, end: int):
    """Gradients of the mean loss of one window (T, B) and the last state (B, H)."""
    hid, (steps, width), real = m.hidden, inputs.shape, m.recur.dtype
    goes_on = (inputs != end).astype(real)                     # a document starts anew
    fed = np.ascontiguousarray(m.embed[inputs].transpose(0, 2, 1))
    recur, h = np.ascontiguousarray(m.recur.T), h.T
    before, z, r, n, un, states = (np.empty((steps, hid, width), real) for _ in range(6))
    for t in range(steps):
        before[t] = h * goes_on[t]
        h, z[t], r[t], n[t], un[t] = _gates(fed[t], recur, before[t])
        states[t] = h
    grads = [np.zeros_like(a) for a in m.arrays()]
    d_embed, d_recur, d_class, d_class_bias, d_word, d_word_bias = grads
    kind, order, edge = _by_class(m, targets.reshape(-1))
    flat, goal, place = _flat(states).take(order, axis=1), targets.reshape(-1)[order], np.arange(targets.size)
    scale = real.type(1.0 / len(goal))
    e, total, x = _softmax(m.to_class.T, m.class_bias, flat)
    loss = float(np.log(total).sum() - x[kind, place].sum())
    e *= scale / total
    e[kind, place] -= scale
    d_class += flat @ e.T
    d_class_bias += e.sum(axis=1)
    d_flat = m.to_class @ e
    for k in range(len(m.cuts) - 1):
        rows, a, b = slice(edge[k], edge[k + 1]), m.cuts[k], m.cuts[k + 1]
        if edge[k] == edge[k + 1] or b - a < 2:
            continue
        own = flat[:, rows]
        e, total, x = _softmax(m.to_word[a:b], m.word_bias[a:b], own)
        word, at = goal[rows] - a, place[:len(total)]
        loss += float(np.log(total).sum() - x[word, at].sum())
        e *= scale / total
        e[word, at] -= scale
        d_word[a:b] = e @ own.T
        d_word_bias[a:b] = e.sum(axis=1)
        d_flat[:, rows] += m.to_word[a:b].T @ e
    back = np.empty_like(order)
    back[order] = place
    d_states = d_flat.take(back, axis=1).reshape(hid, steps, width)
    by_z, by_r, by_n = (before - n) * z * (1 - z), un * r * (1 - r), (1 - z) * (1 - n * n)
    into = np.empty((steps, 3 * hid, width), real)               # gradients of the gates' sums
    later = np.zeros((hid, width), real)
    for t in range(steps - 1, -1, -1):
        dh, x = d_states[:, t] + later, into[t]
        dan = np.multiply(dh, by_n[t], out=by_n[t])
        np.multiply(dh, by_z[t], out=x[:hid])
        np.multiply(dan, by_r[t], out=x[hid:2 * hid])
        np.multiply(dan, r[t], out=x[2 * hid:])
        later = m.recur @ x
        dh *= z[t]
        later += dh
        later *= goes_on[t]
    d_recur += _flat(before) @ _flat(into).T
    into[:, 2 * hid:] = by_n
    words = inputs.reshape(-1).astype(np.min_scalar_type(len(m.embed)))
    order = np.argsort(words, kind="stable")
    met, first = np.unique(words[order], return_index=True)
    d_embed[met] = np.add.reduceat(into.transpose(0, 2, 1).reshape(-1, 3 * hid).take(order, axis=0), first, axis=0)
    return grads, h.T, loss / len(goal)


class Adam:
    """Steps on a model's arrays, in place."""

    def __init__(self, m: Gru):
        self.arrays, self.done = m.arrays(), 0
        self.first, self.second = [np.zeros_like(a) for a in self.arrays], [np.zeros_like(a) for a in self.arrays]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        self.done += 1
        for p, g, u, v in zip(self.arrays, grads, self.first, self.second):
            if norm > 1.0:
                g /= g.dtype.type(norm)
            u *= 0.9
            u += 0.1 * g
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            x = np.multiply(v, 1 / (1 - 0.99 ** self.done), out=g)
            np.sqrt(x, out=x)
            x += 1e-8
            np.divide(u, x, out=x)
            x *= rate / (1 - 0.9 ** self.done)
            p -= x


class Trainer:
    """Trains a model (in place) on every token of the documents added to it. About
    ``most`` tokens at a time are laid out in parallel streams; what does not fill all streams waits
    for the next documents, or is one stream of its own at the end."""

    def __init__(self, m: Gru, end: int, rate: float, streams: int = TASK_STREAMS, window: int = WINDOW, most: int = TASK_TOKENS):
        self.m, self.end, self.rate, self.streams, self.window, self.most = m, end, rate, streams, window, most
        self.adam, self.docs, self.size, self.tokens = Adam(m), [], 0, 0
        self.rest = np.array([end], np.int64)                 # the last input, and targets that wait

    def add(self, doc: np.ndarray) -> None:
        self.docs.append(doc)
        self.size += len(doc)
        if self.size >= self.most:
            self.flush()

    def flush(self) -> None:
        line, total = np.concatenate([self.rest, *self.docs]), self.size + len(self.rest) - 1
        streams = max(1, min(self.streams, total // (64 * self.window)))      # few tokens: rather more steps
        n = total // streams
        self._run(line[:n * streams].reshape(streams, n).T, line[1:n * streams + 1].reshape(streams, n).T)
        self.rest, self.docs, self.size = line[n * streams:], [], 0

    def finish(self) -> None:
        self.flush()
        self._run(self.rest[:-1, None], self.rest[1:, None])
        self.rest = self.rest[-1:]

    def _run(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        h = np.zeros((inputs.shape[1], self.m.hidden), np.float32)
        for a in range(0, len(inputs), self.window):
            grads, h, _ = _gradients(self.m, inputs[a:a + self.window], targets[a:a + self.window], h, self.end)
            self.adam.step(grads, self.rate)
        self.tokens += targets.size


def train(docs: list[np.ndarray], counts: np.ndarray, end: int, *, hidden: int = HIDDEN, classes: int = CLASSES,
          epochs: int = EPOCHS, streams: int = STREAMS, window: int = WINDOW, rate: float = 0.01, seed: int = 5) -> Gru:
    """A model from documents of word numbers, each ending with ``end``. The sample is
    laid out in parallel streams; a window's state is handed to the next window."""
    m = new_model(counts, hidden, classes, seed)
    if not docs:
        return m
    rng = np.random.default_rng(seed)
    adam = Adam(m)
    total = sum(map(len, docs))
    streams = max(1, min(streams, total // (2 * window)))
    updates = max(1, epochs * (total // (streams * window)))
    for _ in range(epochs):
        line = np.concatenate([[end], *(docs[k] for k in rng.permutation(len(docs)))])
        n = (len(line) - 1) // streams
        if n < 1:
            break
        inputs = line[:n * streams].reshape(streams, n).T
        targets = line[1:n * streams + 1].reshape(streams, n).T
        h = np.zeros((streams, hidden), np.float32)
        for a in range(0, n, window):
            grads, h, _ = _gradients(m, inputs[a:a + window], targets[a:a + window], h, end)
            adam.step(grads, rate * max(0.05, 1.0 - (adam.done + 1) / updates))
    return m


def score_sequences(m: Gru, docs: list[np.ndarray], end: int, window: int = 64) -> np.ndarray:
    """Natural log-likelihood of every document (word numbers, each with its end mark),
    all in step, longest first; states are carried from window to window."""
    sizes = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(docs))
    flat = np.concatenate([docs[k] for k in order]) if docs else np.zeros(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes[order])[:-1])) if docs else np.zeros(0, np.int64)
    ordered = sizes[order]
    h = np.zeros((m.hidden, len(docs)), np.float32)
    recur = np.ascontiguousarray(m.recur.T)
    last = np.full(len(docs), end, np.int64)
    most = int(ordered[0]) if len(ordered) else 0
    for a in range(0, most, window):
        states, goals, owners = [], [], []
        for t in range(a, min(a + window, most)):
            live = int(np.searchsorted(-ordered, -t, side="left"))        # documents longer than t
            h = _gates(np.ascontiguousarray(m.embed[last[:live]].T), recur, h[:, :live])[0]
            word = flat[begin[:live] + t]
            states.append(h)
            goals.append(word)
            owners.append(np.arange(live))
            last = word
        goal, owner, state = np.concatenate(goals), np.concatenate(owners), np.concatenate(states, axis=1)
        for k in range(0, len(goal), BLOCK):
            lp = log_probs(m, state[:, k:k + BLOCK].T, goal[k:k + BLOCK])
            out += np.bincount(owner[k:k + BLOCK], lp, len(docs))
    back = np.empty(len(docs))
    back[order] = out
    return back


# -- Spark ---------------------------------------------------------------------

def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return crc_of_id(doc_id) % folds == fold


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over whole texts; each task counts before it hands on."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def table(held, texts):
            n = pa.chunked_array(held, pa.large_string()).value_counts()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([n.field("values").cast(pa.string()), pa.array([END])]),
                                               pa.concat_arrays([n.field("counts"), pa.array([texts], pa.int64())])],
                                              names=["token", "n"])

        held, size, texts = [], 0, 0
        for batch in batches:
            words, cuts = words_of(batch.column("text"))
            held.append(words)
            size, texts = size + words.nbytes, texts + len(cuts)
            if size >= FLUSH:
                yield table(held, texts)
                held, size, texts = [], 0, 0
        if texts:
            yield table(held, texts)

    return (docs.select("text").mapInArrow(run, "token string, n bigint")
            .groupBy("token").agg(F.sum("n").alias("c")))


def most_frequent(counts: DataFrame, most: int) -> list:
    """At most ``most`` of the most frequent tokens (and the end mark), by falling count.

    A limit after a sort would send that many rows from *every* task to the driver.
    Here the counts are put into eighth-powers of two (a few hundred rows at any
    size), the least power that keeps within ``most`` is chosen, and only the rows
    above it are collected."""
    power = F.floor(F.log2(F.col("c").cast("double")) * 8)
    total, least = 0, None
    for r in sorted(counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["p"]):
        total += r["n"]
        if total > most:
            break
        least = r["p"]
    rows = counts.filter((F.col("token") == END) | ((power >= least) if least is not None else F.lit(False))).collect()
    return sorted(rows, key=lambda r: (-r["c"], r["token"]))


@dataclass
class Scorer:
    """What a task needs: the model, the head counts, and the corpus totals."""
    model: Gru | None
    words: list[str]             # model words by number; number 0 is the rare word
    head: list[str]
    head_counts: np.ndarray
    n: int
    v: int
    trained: int = 0             # tokens that the model was trained on, over all rounds

    def prepare(self) -> Scorer:
        import pyarrow as pa

        self.table = pa.array(self.head, pa.large_string())
        number = dict(zip(self.head, range(len(self.head))))
        at = {w: k for k, w in enumerate(self.words)}
        self.word_of = np.array([at.get(w, 0) for w in self.head] + [0], np.int32)      # last: not in the head
        self.end, self.end_in_head = at.get(END, 0), number.get(END, -1)
        per = np.log10((self.head_counts + 1.0) / (self.n + self.v + 1.0))
        self.base = np.append(per, 0.0)
        self.spelled = np.append(np.where(self.word_of[:-1] == 0, per, 0.0), 0.0)
        inside = sum((self.head_counts[number[w]] + 1.0) / (self.n + self.v + 1.0) for w in self.words[1:])
        self.rest = float(np.log10(max(1.0 - inside, 1e-300)))
        return self

    def run(self, texts):
        """Per text of an Arrow array: tokens, known ones, base score and score without the
        tail, and the tail tokens with their times."""
        import pyarrow as pa

        words, cuts = words_of(texts)
        found = codes_of(words, self.table)
        every = with_ends(found, cuts, self.end_in_head)
        size = np.diff(cuts, prepend=0) + 1
        begin = np.cumsum(size) - size                               # a text has one token at least
        base = np.add.reduceat(self.base[every], begin)
        score = base
        if self.model is not None:
            inside = self.word_of[every]
            deep = score_sequences(self.model, np.split(inside, begin[1:]), self.end) / np.log(10.0)
            score = deep + np.add.reduceat(self.spelled[every], begin) - np.add.reduceat(inside == 0, begin, dtype=np.int64) * self.rest
        gone = np.flatnonzero(every < 0)
        owner = np.searchsorted(begin, gone, side="right") - 1
        coded = words.filter(pa.array(found < 0)).dictionary_encode()
        names = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())])
        code = np.full(len(gone), len(names) - 1)
        code[gone != (begin + size - 1)[owner]] = coded.indices.to_numpy()            # the others are end marks
        met, times = np.unique(owner * len(names) + code, return_counts=True)
        offsets = pa.array(np.searchsorted(met, np.arange(len(size) + 1) * len(names)), pa.int32())
        missing = np.bincount(owner, minlength=len(size))
        return (pa.array(size, pa.int64()), pa.array(size - missing, pa.int64()), pa.array(base), pa.array(score),
                pa.ListArray.from_arrays(offsets, names.take(pa.array(met % len(names))).cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())))


MODEL = "params binary, n bigint"


def train_all(rows: DataFrame, model: Gru, at: dict[str, int], rounds: int = ROUNDS, rate: float = TASK_RATE) -> tuple[Gru, int]:
    """The model after training on all tokens of ``rows``, and their number. Each row is in one
    of the rounds; in a round every task goes on from the broadcast model over its rows."""
    spark = rows.sparkSession
    ship(spark)
    small_batches(spark)
    total = 0
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((model, at))               # bounded by VOCABULARY and HIDDEN

        def run(batches, shared=shared, rate=rate * (1.0 - 0.5 * k / max(1, rounds - 1))):
            import pyarrow as pa

            start, number = shared.value
            table = pa.array(number.keys(), pa.large_string())
            number_of = np.array([*number.values(), 0], np.int64)                # last: the rare word
            own = Trainer(Gru(*(a.copy() for a in start.arrays()), start.cuts), number[END], rate)
            for batch in batches:
                words, cuts = words_of(batch.column("text"))
                line = with_ends(number_of[codes_of(words, table)], cuts, number[END])
                for doc in np.split(line, (cuts + np.arange(1, len(cuts) + 1))[:-1]):
                    own.add(doc)
            own.finish()
            if own.tokens:
                flat = np.concatenate([a.reshape(-1) for a in own.m.arrays()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([own.tokens], pa.int64())],
                                                 names=["params", "n"])

        mine = F.pmod(F.xxhash64("doc_id", "text", F.lit("round")), F.lit(rounds)) == k
        flat, n = _average(stage(rows.filter(mine).select("text").mapInArrow(run, MODEL), "lm-models"))
        if n:
            cut = np.cumsum([a.size for a in model.arrays()])[:-1]
            model = Gru(*(x.reshape(a.shape) for x, a in zip(np.split(flat, cut), model.arrays())), model.cuts)
            total += n
        shared.unpersist()
    return model, total


def _average(models: DataFrame) -> tuple[np.ndarray | None, int]:
    """The mean of the models by their tokens; tasks average until at most MODELS are left."""
    def mean(rows):
        flat, n = None, 0
        for params, tokens_n in rows:
            x = np.frombuffer(params, np.float32).astype(np.float64) * tokens_n
            flat, n = x if flat is None else flat + x, n + tokens_n
        return (flat / n).astype(np.float32) if n else None, n

    def add(batches):
        import pyarrow as pa

        flat, n = mean((p, c) for b in batches for p, c in zip(b.column("params").to_pylist(), b.column("n").to_pylist()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["params", "n"])

    while (left := models.count()) > MODELS:
        models = stage(models.coalesce(-(-left // MODELS)).mapInArrow(add, MODEL), "lm-models")
    return mean((r["params"], r["n"]) for r in models.orderBy("n", F.xxhash64("params")).collect())


def fit(docs: DataFrame, train_on: Column, *, vocabulary: int = VOCABULARY, head: int = HEAD,
        sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS, **options) -> tuple[DataFrame, Scorer]:
    """Counts of all training tokens (staged) and the scorer."""
    rows = docs.select("doc_id", "text").filter(train_on)
    counts = stage(count_tokens(rows), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, head)
    scorer = Scorer(None, ["\0rare"], [r["token"] for r in top], np.array([r["c"] for r in top], np.float64), int(n), int(v))
    if not top:
        return counts, scorer
    some = [r["token"] for r in top[:vocabulary - 1]]
    if END not in some:
        some[-1] = END
    rare = float(n) - sum(r["c"] for r in top[:len(some)])
    freq = {r["token"]: float(r["c"]) for r in top}
    docs_n = max(1, int(freq.get(END, sample_docs)))                                  # one end mark a document
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_docs / docs_n))
    texts = [r["text"] for r in rows.filter(draw).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"),
                                                         F.xxhash64("text", "doc_id").alias("k"))
             .orderBy("k").limit(4 * sample_docs).collect()]
    # Model words: the rare word first, then by falling frequency (classes are ranges).
    scorer.words = ["\0rare", *some]
    counted = np.array([rare, *(freq.get(w, 0.0) for w in some)])
    at = {w: k for k, w in enumerate(scorer.words)}
    sample, size = [], 0
    for t in texts:
        seq = np.array([at.get(w, 0) for w in tokens(t)], np.int64)[:sample_tokens - size]
        if len(seq):
            sample.append(seq)
        size += len(seq)
    scorer.model, scorer.trained = train_all(rows, train(sample, counted, at[END], **options), at)
    return counts, scorer


def score_documents(docs: DataFrame, counts: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)            # bounded by HEAD and VOCABULARY
    key = f"gru-{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        ready, at = held(key, shared.value.prepare), TaskContext.get().partitionId() << 40
        ids, texts, size, docs_n = [], [], 0, 0

        def table():
            nonlocal at
            cols = ready.run(pa.concat_arrays(texts))
            pa.default_memory_pool().release_unused()
            rows = pa.array(range(at, at + len(cols[0])), pa.int64())
            at += len(cols[0])
            return pa.RecordBatch.from_arrays([rows, pa.concat_arrays(ids), *cols],
                                              names=["ord", "doc_id", "n_tokens", "known", "base", "deep", "tail", "times"])

        for batch in batches:
            if not len(batch):
                continue
            ids.append(batch.column("doc_id"))
            texts.append(batch.column("text").cast(pa.large_string()))
            docs_n += len(batch)
            size += (pc.sum(pc.utf8_length(texts[-1])).as_py() or 0) // 5
            if size >= GROUP_TOKENS or docs_n >= GROUP_DOCS:
                yield table()
                ids, texts, size, docs_n = [], [], 0, 0
        if texts:
            yield table()

    scored = stage(docs.select("doc_id", "text").mapInArrow(
        run, f"ord bigint, doc_id {kind}, n_tokens bigint, known bigint, base double, deep double, "
             "tail array<string>, times array<bigint>"), "lm-scored")
    log_all = F.log10(F.lit(float(scorer.n + scorer.v + 1)))
    tail = scored.select("ord", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("ord", "x.tail", "x.times")
    met = tail.join(counts, tail["tail"] == counts["token"], "left")
    sums = met.groupBy("ord").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - log_all)).alias("tail_base"),
        F.sum("times").alias("tail_n"))
    out = scored.drop("tail", "times").join(sums, "ord", "left")
    extra = F.coalesce("tail_base", F.lit(0.0))
    # The rare word's probability mass was divided out in the task already.
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                      F.lit(scorer.n).cast("bigint").alias("train_tokens"),
                      (F.col("base") + extra).alias("base_score"), (F.col("deep") + extra).alias("score"))


def score_corpus(docs: DataFrame, train_on: Column, **options) -> DataFrame:
    counts, scorer = fit(docs, train_on, **options)
    return score_documents(docs, counts, scorer)


