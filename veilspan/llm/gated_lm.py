"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words and one end per document, named by 64-bit hashes. Counts cover every training token. The 1,024 most
frequent tokens form 32 classes of 32 by frequency; all others are the rare class, within which a token has its share of
the smoothed counts. The network (numpy, 16 gated units) predicts the class, and for a frequent token its place in the class.

Training is one pass over all training documents by truncated backpropagation (windows of 16 tokens, the state is carried from
window to window and cleared at a document's start), in three rounds of 1/8, 3/8 and 4/8 of the documents by hash. In a round, every
task trains on its own documents from the same start; Spark averages the parameters, weighted by tokens.
Scoring carries the state across windows through the whole document.

A block is some 12 MB of documents, made where they are read. The counts a block needs reach it by a join on (block, token),
so the vocabulary is nowhere held whole, and a frequent token is one row per block. The network's size is fixed.

Defined cases: null text counts as empty (the end alone); without training tokens all counts are 0 and the network is as it
starts. Rows that repeat a doc_id, or have none, are scored one by one. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.text import WHITE, utf8, word_blocks
from veilspan.session import materialise

UNITS = 16
CLASSES = 32
MEMBERS = 32
FREQUENT = CLASSES * MEMBERS
RARE = FREQUENT
START = FREQUENT + 1
WINDOW = 16
LANES = 512
#: Tokens whose outputs are worked out at a time.
TALL = 16_384
ROUNDS = ((0, 1), (1, 4), (4, 8))
BLOCK_BYTES = 12 << 20
SMOOTH = 0.1
END_TOKEN = 1

_SHAPES = {
    "embed": (FREQUENT + 2, UNITS),
    "input": (UNITS, 3 * UNITS),
    "state": (UNITS, 3 * UNITS),
    "gate_bias": (3 * UNITS,),
    "class": (UNITS, CLASSES + 1),
    "class_bias": (CLASSES + 1,),
    "member": (CLASSES, UNITS, MEMBERS),
    "member_bias": (CLASSES, MEMBERS),
}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


class Network:
    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat.astype(np.float32)
        self.part: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            self.part[name] = self.flat[at : at + n].reshape(shape)
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, rare: float) -> Network:
        """Small random weights; biases from the counts of the frequent tokens and of the rare ones together."""
        net = cls(np.random.default_rng(5).normal(0, 0.15, SIZE))
        net.part["gate_bias"][:] = 0
        own = np.zeros(FREQUENT)
        own[: len(counts)] = counts
        own = (own + SMOOTH).reshape(CLASSES, MEMBERS)
        net.part["class_bias"][:] = np.log(np.append(own.sum(axis=1), rare + SMOOTH) / (own.sum() + rare + SMOOTH))
        net.part["member_bias"][:] = np.log(own / own.sum(axis=1, keepdims=True))
        return net

    def forward(self, inputs: np.ndarray, keep: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """States after each step. ``inputs``, ``keep``: steps by lanes; keep is 0 where a document starts."""
        p, u = self.part, UNITS
        x = p["embed"][inputs] @ p["input"] + p["gate_bias"]
        states = np.empty((*inputs.shape, u), np.float32)
        trace = []
        for t in range(len(inputs)):
            before = state * keep[t][:, None]
            y = before @ p["state"]
            gates = x[t, :, : 2 * u] + y[:, : 2 * u]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :u], gates[:, u:]
            new = np.tanh(x[t, :, 2 * u :] + r * y[:, 2 * u :])
            state = before + z * (new - before)
            states[t] = state
            trace.append((before, z, r, new, y))
        return states, trace

    def outputs(self, states: np.ndarray, targets: np.ndarray, learn: bool) -> tuple[np.ndarray, dict | None]:
        """Natural log probability of the targets (rare ones: of their class); for learning also the gradients."""
        p = self.part
        cls = targets // MEMBERS
        logits = states @ p["class"] + p["class_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        share = np.exp(logits)
        total = share.sum(axis=1)
        every = np.arange(len(targets))
        logs = logits[every, cls] - np.log(total)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        grads = None
        if learn:
            share /= total[:, None]
            share[every, cls] -= 1
            back = share @ p["class"].T
            grads = {"class": states.T @ share, "class_bias": share.sum(axis=0), "member": np.zeros(_SHAPES["member"], np.float32),
                     "member_bias": np.zeros(_SHAPES["member_bias"], np.float32), "back": back}
        for c in range(CLASSES):
            rows = order[bounds[c] : bounds[c + 1]]
            if not len(rows):
                continue
            own = states[rows]
            logits = own @ p["member"][c] + p["member_bias"][c]
            logits -= logits.max(axis=1, keepdims=True)
            share = np.exp(logits)
            total = share.sum(axis=1)
            place = targets[rows] % MEMBERS
            logs[rows] += logits[np.arange(len(rows)), place] - np.log(total)
            if learn:
                share /= total[:, None]
                share[np.arange(len(rows)), place] -= 1
                grads["member"][c] = own.T @ share
                grads["member_bias"][c] = share.sum(axis=0)
                grads["back"][rows] += share @ p["member"][c].T
        return logs, grads

    def gradient(self, inputs: np.ndarray, keep: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat gradient per token of one window, and the state after it (truncated backpropagation)."""
        p, u = self.part, UNITS
        states, trace = self.forward(inputs, keep, state)
        _, g = self.outputs(states.reshape(-1, u), targets.ravel(), True)
        back = g["back"].reshape(states.shape)
        d_x = np.empty((*inputs.shape, 3 * u), np.float32)
        d_state = np.zeros(_SHAPES["state"], np.float32)
        later = np.zeros_like(state)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, y = trace[t]
            d = back[t] + later
            d_new = d * z * (1 - new * new)
            d_y = np.empty((len(d), 3 * u), np.float32)
            d_x[t, :, 2 * u :] = d_new
            d_y[:, 2 * u :] = d_new * r
            d_x[t, :, :u] = d_y[:, :u] = d * (new - before) * z * (1 - z)
            d_x[t, :, u : 2 * u] = d_y[:, u : 2 * u] = d_new * y[:, 2 * u :] * r * (1 - r)
            d_state += before.T @ d_y
            later = (d * (1 - z) + d_y @ p["state"].T) * keep[t][:, None]
        flat_x = d_x.reshape(-1, 3 * u)
        seen = inputs.ravel()
        d_in = flat_x @ p["input"].T
        order = np.argsort(seen, kind="stable")
        used, first = np.unique(seen[order], return_index=True)
        d_embed = np.zeros(_SHAPES["embed"], np.float32)
        d_embed[used] = np.add.reduceat(d_in[order], first, axis=0)
        parts = {"embed": d_embed, "input": p["embed"][seen].T @ flat_x, "state": d_state, "gate_bias": flat_x.sum(axis=0), **g}
        flat = np.concatenate([parts[name].ravel() for name in _SHAPES]) / targets.size
        return flat, states[-1]


class Trainer:
    """Adaptive moment steps from a given start; documents are laid into lanes one after the other."""

    def __init__(self, net: Network, rate: float = 0.01) -> None:
        self.net, self.rate, self.steps, self.tokens = net, rate, 0, 0
        self.first, self.second = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)

    def learn(self, ids: np.ndarray, begins: np.ndarray) -> None:
        """``ids``: the tokens of whole documents, one after the other; ``begins``: their first places."""
        lanes = int(min(LANES, max(1, len(ids) // WINDOW)))
        steps = -(-len(ids) // lanes)
        before = np.concatenate(([START], ids[:-1]))
        before[begins] = START
        keep = np.ones(len(ids), np.float32)
        keep[begins] = 0
        # The last column is filled up with the first tokens again: none is left out.
        lay = lambda x: np.ascontiguousarray(np.resize(x, steps * lanes).reshape(lanes, steps).T)
        inputs, targets, keep = lay(before), lay(ids), lay(keep)
        state = np.zeros((lanes, UNITS), np.float32)
        for t in range(0, steps, WINDOW):
            part = slice(t, t + WINDOW)
            grad, state = self.net.gradient(inputs[part], keep[part], targets[part], state)
            norm = float(np.sqrt((grad * grad).sum()))
            if norm > 1:
                grad /= norm
            self.steps += 1
            self.first += 0.1 * (grad - self.first)
            self.second += 0.01 * (grad * grad - self.second)
            scale = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.net.flat -= np.float32(self.rate * scale) * self.first / (np.sqrt(self.second) + np.float32(1e-6))
            self.tokens += inputs[part].size


def log_probabilities(net: Network, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log probability of every token; each document runs through one lane, whole and from an empty state."""
    lengths = np.diff(np.append(begins, len(ids)))
    longest = int(lengths.max(initial=1))
    lanes = int(np.clip(len(ids) // longest, 16, LANES))
    load = [(0, lane) for lane in range(lanes)]
    at, lane_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for doc in np.argsort(-lengths, kind="stable"):
        used, lane = heapq.heappop(load)
        at[doc], lane_of[doc] = used, lane
        heapq.heappush(load, (used + int(lengths[doc]), lane))
    step = np.arange(len(ids)) + np.repeat(at - begins, lengths)
    lane = np.repeat(lane_of, lengths)
    before = np.concatenate(([START], ids[:-1]))
    before[begins] = START
    steps = int(step.max(initial=-1)) + 1
    # Lanes of most steps first: those still running are always the first ones.
    size = np.bincount(lane, minlength=lanes)
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(lanes)
    lane = rank[lane]
    size = np.sort(size)[::-1]
    grid = np.full((steps, lanes), -1, np.int32)
    grid[step, lane] = np.arange(len(ids))
    out = np.zeros(len(ids))
    state = np.zeros((lanes, UNITS), np.float32)
    keep = np.ones(len(ids) + 1, np.float32)
    keep[begins] = 0
    t = 0
    while t < steps:
        running = int(np.searchsorted(-size, -t, "left"))
        # Few long documents left: more steps at a time.
        tall = max(2 * WINDOW, TALL // running)
        place = grid[t : t + tall, :running]
        some = place >= 0
        inputs = np.where(some, before[place], START)
        states, _ = net.forward(inputs, np.where(some, keep[place], 1), state[:running])
        state[:running] = states[-1]
        logs, _ = net.outputs(states[some], ids[place[some]], False)
        out[place[some]] = logs
        t += tall
    return out


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, tokens, begins): tokens of documents ``low:high`` with their ends, and where each document begins."""
    for low, high, hashes, _, _, first in word_blocks(column, WHITE):
        docs = high - low
        tokens = np.full(len(hashes) + docs, END_TOKEN, np.uint64)
        tokens[np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(first))] = hashes
        yield low, high, tokens, first[:-1] + np.arange(docs)


def _blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, text, held_out, turn (a hash of 8 for the rounds) and block: documents that were read together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets, _ = utf8(batch.column("text"))
            size_at = size + (offsets[1:] - offsets[0])
            block = number + size_at // BLOCK_BYTES
            number, size = int(block[-1]) if len(block) else number, int(size_at[-1] % BLOCK_BYTES) if len(block) else size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], [*batch.schema.names, "block"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(8)).cast("int").alias("turn")
    )
    return rows.mapInArrow(run, "doc_id long, text string, held_out boolean, turn int, block long")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, token, n): n counts training documents only."""

    def rows(block: int, tokens: list[np.ndarray], learned: list[np.ndarray]) -> pa.RecordBatch:
        found, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(learned), len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found.view(np.int64)), pa.array(n)], ["block", "token", "n"])

    current, tokens, learned, size = None, [], [], 0
    for batch in batches:
        blocks, held = batch.column("block").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for low, high, own, begins in _tokens(batch.column("text")):
            ends = np.append(begins[1:], len(own))
            for block in np.unique(blocks[low:high]):
                mine = np.flatnonzero(blocks[low:high] == block)
                if (current is not None and block != current) or size > 4_000_000:
                    yield rows(current, tokens, learned)
                    tokens, learned, size = [], [], 0
                current = block
                a, b = begins[mine[0]], ends[mine[-1]]
                tokens.append(own[a:b]), learned.append(np.repeat(~held[low:high][mine], ends[mine] - begins[mine]).astype(float))
                size += b - a
    if tokens:
        yield rows(current, tokens, learned)


def _train(net: Network, tokens: np.ndarray, place: np.ndarray, spark, blocks: DataFrame) -> Network:
    """One pass over the training documents of ``blocks``. ``tokens`` (sorted) are the frequent ones; ``place`` their numbers."""
    for low, high in ROUNDS:
        sent = spark.sparkContext.broadcast((net.flat, tokens, place))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            flat, tokens, place = sent.value
            trainer = Trainer(Network(flat.copy()))
            for batch in batches:
                for _, _, own, begins in _tokens(batch.column("text")):
                    trainer.learn(numbers(own, tokens, place), begins)
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(trainer.net.flat.astype(float) * trainer.tokens), pa.array(np.full(SIZE, float(trainer.tokens)))],
                    ["at", "weighted", "weight"],
                )

        mine = blocks.where(~F.col("held_out") & (F.col("turn") >= low) & (F.col("turn") < high)).select("text")
        found = mine.mapInArrow(run, "at int, weighted double, weight double").groupBy("at")
        found = found.agg((F.sum("weighted") / F.sum("weight")).alias("value")).toArrow()  # the network's size, at most
        if found.num_rows:
            flat = np.empty(SIZE, np.float32)
            flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
            net = Network(flat)
    return net


def numbers(own: np.ndarray, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Network numbers of tokens; ``RARE`` for all that are not frequent."""
    if not len(tokens):
        return np.full(len(own), RARE, np.int64)
    at = np.searchsorted(tokens, own)
    at[at == len(tokens)] = 0
    return np.where(tokens[at] == own, place[at], RARE)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    blocks = materialise(_blocks(docs, held_out), "blocks")
    found = blocks.select("block", "held_out", "text").mapInArrow(_count, "block long, token long, n long")
    # Texts are read and hashed once for all counts: each token's rows, at most a few a block, learn their sum where they meet.
    of_token = Window.partitionBy("token").orderBy("block")
    whole = of_token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = found.select("block", "token", F.sum("n").over(whole).alias("c"), (F.row_number().over(of_token) == 1).alias("first"))
    known = materialise(known.where("c > 0"), "known")
    counts = known.where("first")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.select("token", "c").orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    tokens, most = top.column("token").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(tokens)
    tokens, place = tokens[order], order.astype(np.int64)
    net = Network.start(most, total - most.sum())
    net = _train(net, tokens, place, spark, blocks)
    rare_sum = float(total - most.sum() + SMOOTH * (distinct - len(most) + 1))
    sent = spark.sparkContext.broadcast((net.flat, tokens, place))

    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        flat, tokens, place = sent.value
        net = Network(flat)
        of, c = known.column("token").to_numpy().view(np.uint64), known.column("c").to_numpy()
        order = np.argsort(of)
        of, c = of[order], c[order]
        parts, sizes = [], []
        for chunk in texts.column("text").chunks:
            for _, _, own, begins in _tokens(chunk):
                parts.append(own), sizes.append(np.diff(np.append(begins, len(own))))
        own = np.concatenate(parts)
        begins = np.concatenate(([0], np.cumsum(np.concatenate(sizes))[:-1]))
        if len(of):
            at = np.searchsorted(of, own)
            at[at == len(of)] = 0
            hit = of[at] == own
            count = np.where(hit, c[at], 0)
            # A frequent token is a known one: its number stands beside its count.
            ids = np.where(hit, numbers(of, tokens, place)[at], RARE)
        else:
            count, ids = np.zeros(len(own), np.int64), np.full(len(own), RARE)
        base = np.log10((count + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        logs = log_probabilities(net, ids, begins) / np.log(10)
        rare = ids == RARE
        logs[rare] += np.log10((count[rare] + SMOOTH) / rare_sum)
        n = np.diff(np.append(begins, len(own)))
        known_n = np.add.reduceat((count > 0).astype(np.int64), begins)
        return pa.table(
            [
                texts.column("doc_id"), texts.column("held_out"), pa.array(n, pa.int64()), pa.array(known_n, pa.int64()),
                pa.array(np.full(len(n), total, np.int64)), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(logs, begins)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # A token that no training document has is absent here and counts as 0.
    wanted = known.select("block", "token", "c")
    texts = blocks.select("block", "doc_id", "held_out", "text")
    return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, schema)
