"""Language-model scores from a weighted backoff automaton of all n-grams up to three words.

A state is the longest suffix of what was read that is itself an n-gram of the model, an arc reads a word with a probability, and a failure arc
leads to the next shorter suffix with a backoff weight.  A text's score is the sum of the log10 probabilities along its one traversal from left
to right, which carries the state.

The model holds every n-gram of the training texts, whatever the size of the corpus, and no part of it is held in one place.  Texts are cut into
blocks of tokens.  A block asks for the counts of its distinct n-grams; requests are dealt by ranges of n-gram hashes, in number with the bytes of
the texts, so a key reaches its range at most once a block, however frequent it is.  The answers meet the block again: they are the states and arcs
that its texts can reach, and the texts are read through them.  Of every n-gram one block is the owner; it adds the n-gram to the sums of its
history, from which the weights of the failure arcs follow.  Histories go to ranges of hashes as n-grams do, and back to the blocks that failed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.words import Block, blocks, mix

#: What is taken off every n-gram's count lies between these; within them it is estimated from how many n-grams occur once and twice.
DISCOUNTS = 0.5, 0.95
#: Tokens that a task looks up together.
BLOCK_TOKENS = 750_000
#: Bytes of texts for each range of n-gram hashes.
RANGE_BYTES = 8 << 20
#: Longer rows are read in stretches of so many tokens side by side.
STRETCH = 256
#: Bits of the hash of an n-gram of two or three words beyond those that number the bytes of the texts: of all such n-grams a share of about 2^-22
#: has another's key, at every size.  Single words have 63 bits, as their counts are results.
SPARE_BITS = 22
_WORD_BITS = 32
#: The word that ends a text.
END = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 1.  A null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1


def block_tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each row closed by the end, and the index of each row's first token."""
    counts = block.counts()
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    tokens = np.full(first[-1], END, np.uint64)
    last = np.zeros(len(tokens), bool)
    last[first[1:] - 1] = True
    tokens[~last] = block.hashes()
    return tokens, first


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate([t for t, _ in held])
    shift = np.concatenate([[0], np.cumsum([len(t) for t, _ in held])])
    first = np.concatenate([f[:-1] + s for (_, f), s in zip(held, shift)] + [shift[-1:]])
    return tokens, first


def key_bits(size: int) -> int:
    """Bits of the keys of orders 2 and 3 over texts of ``size`` bytes."""
    return min(63, SPARE_BITS + max(1, size).bit_length())


def _grams(tokens: np.ndarray, first: np.ndarray, bits: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Per order: the places where an n-gram ends that doesn't cross a row's start, and a key (the first bits of a hash) for each."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    one = mix(tokens)
    two = np.zeros_like(one)
    two[1:] = mix(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + tokens[1:])
    three = np.zeros_like(one)
    three[1:] = mix(two[:-1] * np.uint64(0xA0761D6478BD642F) + tokens[1:])
    at = {1: np.arange(len(tokens)), 2: np.flatnonzero(place >= 1), 3: np.flatnonzero(place >= 2)}
    # The lowest bit is left free for a flag that is sorted along.
    short = ~np.uint64((1 << (64 - bits)) - 1)
    return at, {1: one & ~np.uint64(1), 2: two[at[2]] & short, 3: three[at[3]] & short}


def _packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as bytes, those of equal rank together; ascending ones as steps."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def _unpacked(blob: bytes, dtype, ascending: bool = False) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(raw.T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if ascending else values


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys in which equal ones are together, where each distinct one starts in it, and each key's number among those."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), inverse


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes starts among ascending keys."""
    edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _blocks(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """A row for each document, with its block and place in it, and a row (of no ``_at``) for each block: distinct words, tokens, first tokens, held-out rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def passed():
            ids, outs, rows = zip(*held)
            tokens, first = _joined(list(rows))
            out = np.concatenate(outs)
            words, index = np.unique(tokens, return_inverse=True)
            blobs = [_packed(words, True), _packed(index.astype(np.int32)), _packed(first, True), _packed(out.astype(np.uint8))]
            documents = [pa.concat_arrays(ids), pa.array(out), pa.array(np.arange(len(out))), pa.array(np.diff(first)), pa.array(np.full(len(out), number)), *[pa.nulls(len(out), pa.binary())] * 4]
            yield pa.RecordBatch.from_arrays(documents, names)
            block = [pa.nulls(1, ids[0].type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([number]), *(pa.array([x], pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(block, names)

        for batch in batches:
            for block in blocks(batch.column(2)):
                tokens = block_tokens(block)
                held.append((batch.column(0).slice(block.first, block.rows), batch.column(1).slice(block.first, block.rows).to_numpy(zero_copy_only=False).astype(bool), tokens))
                n += len(tokens[0])
                if n >= limit:
                    yield from passed()
                    held, n, number = [], 0, number + 1
        if held:
            yield from passed()

    names = ["_id", "held_out", "_at", "n_tokens", "block", "a", "b", "c", "d"]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col), F.col(text_col).cast("string"))
    return map_batches(rows, scan, f"_id {id_type}, held_out boolean, _at bigint, n_tokens bigint, block bigint, a binary, b binary, c binary, d binary")


def _block_read(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block and the index of each row's first."""
    return _unpacked(a, np.uint64, True)[_unpacked(b, np.int32)], _unpacked(c, np.int64, True)


def _asked(texts: DataFrame, parts: int, bits: int) -> DataFrame:
    """Per block, order (``kind``) and range (``part``) of hashes: ``a`` the distinct n-grams' keys, ``b`` their counts in the block's training texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                tokens, first = _block_read(*row[:3])
                trains = np.repeat(_unpacked(row[3], np.uint8) ^ 1, np.diff(first)).astype(np.uint64)
                at, keys = _grams(tokens, first, bits)
                for order in (1, 2, 3):
                    flagged = np.sort(keys[order] | trains[at[order]])
                    if not len(flagged):
                        continue
                    found = flagged & ~np.uint64(1)
                    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                    found, counts = found[starts], np.add.reduceat(flagged & np.uint64(1), starts).astype(np.int32)
                    cuts = _cuts(found, parts)
                    some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                    slices = [slice(cuts[p], cuts[p + 1]) for p in some]
                    columns = [pa.array(np.full(len(some), order, np.int32)), pa.array(np.full(len(some), number)), pa.array(some, pa.int32()),
                               pa.array([_packed(found[x], True) for x in slices], pa.binary()), pa.array([_packed(counts[x]) for x in slices], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "block", "part", "a", "b"])

    return texts.mapInArrow(scan, "kind int, block bigint, part int, a binary, b binary")


def _told(requests: DataFrame) -> DataFrame:
    """Per request: ``a`` the count over all training texts of each key, ``b`` whether the block owns it (1) and nobody else asked (2); and the range's sums on one row."""

    def answer(table: pa.Table) -> pa.Table:
        keys = [_unpacked(x.as_py(), np.uint64, True) for x in table["a"]]
        sizes = np.cumsum([0, *map(len, keys)])
        counts = np.concatenate([_unpacked(x.as_py(), np.int32) for x in table["b"]]).astype(np.int64)
        order, starts, inverse = _grouped(np.concatenate(keys))
        total = np.add.reduceat(counts[order], starts)
        owner = np.zeros(len(counts), np.uint8)
        one = np.maximum.reduceat(np.where(counts[order] > 0, order, -1), starts)  # any request that has trained on it
        owner[one[one >= 0]] = 1
        owner |= (np.diff(np.append(starts, len(order))) == 1).astype(np.uint8)[inverse] << 1
        told = total[inverse]
        rows = range(len(keys))
        sums = [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()]
        columns = [table["kind"], table["block"], table["part"], pa.array([_packed(told[sizes[i] : sizes[i + 1]]) for i in rows], pa.binary()), pa.array([_packed(owner[sizes[i] : sizes[i + 1]]) for i in rows], pa.binary())]
        return pa.table([*columns, *(pa.array([int(s)] + [0] * (len(keys) - 1), pa.int64()) for s in sums)], ["kind", "block", "part", "a", "b", "tokens", "types", "once", "twice"])

    schema = "kind int, block bigint, part int, a binary, b binary, tokens bigint, types bigint, once bigint, twice bigint"
    return requests.groupBy("kind", "part").applyInArrow(answer, schema)


def discount(once: int, twice: int) -> float:
    """n1 / (n1 + 2 n2) of the n-grams that occur once and twice, within DISCOUNTS."""
    return float(np.clip(once / max(1, once + 2 * twice), *DISCOUNTS))


@dataclass
class Automaton:
    """The states and arcs that a block's texts can reach: 0 is the empty suffix, then a state per word, then one per pair of words.

    ``arcs`` are ascending keys ``state << 32 | word`` with log10 probabilities and the state that they lead to; ``fail`` is the state behind every
    state's failure arc.  The empty suffix has an arc for every word.
    """

    arcs: np.ndarray
    logp: np.ndarray
    target: np.ndarray
    fail: np.ndarray

    def steps(self, state: np.ndarray, word: np.ndarray, place: np.ndarray, failures: list | None) -> tuple[np.ndarray, np.ndarray]:
        """State and log10 probability after reading a word; ``failures`` takes (place, state) of each failure arc that was followed."""
        score, out, open_ = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            key = (state[open_] << _WORD_BITS) | word[open_]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            score[open_[hit]] = self.logp[at[hit]]
            out[open_[hit]] = self.target[at[hit]]
            open_ = open_[~hit]
            if failures is not None:
                failures.append((place[open_], state[open_]))
            state[open_] = self.fail[state[open_]]
        return out, score

    def traverse(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of word numbers the log10 probability but for failure arcs; row and state of every failure arc that was followed.

        Rows are read side by side, word by word.  A long row is read in stretches side by side too: the state at a cut is the one that the two
        words before it lead to, as no state is longer than that.
        """
        counts = np.diff(first)
        stretches = -(-counts // STRETCH)
        row = np.repeat(np.arange(len(counts)), stretches)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * STRETCH
        length = np.minimum(counts[row] - place, STRETCH)
        order = np.argsort(-length, kind="stable")
        row, start, length, cut = row[order], (first[:-1][row] + place)[order], length[order], np.flatnonzero(place[order])
        state, score, failures = np.zeros(len(row), np.int64), np.zeros(len(row)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for back in (2, 1):
            state[cut], _ = self.steps(state[cut], words[start[cut] - back], row[cut], None)
        ascending = length[::-1]
        for step in range(int(length.max(initial=0))):
            n = len(length) - int(np.searchsorted(ascending, step, "right"))  # stretches that have a word left
            state[:n], gained = self.steps(state[:n].copy(), words[start[:n] + step], row[:n], failures)
            score[:n] += gained
        rows, states = (np.concatenate(x) for x in zip(*failures))
        return np.bincount(row, weights=score, minlength=len(counts)), rows, states


def _read(texts: DataFrame, told: DataFrame, off: dict[int, float], denominator: float, bits: int, ranges: int) -> DataFrame:
    """What blocks read, by kind.

    0: per row of a block ``x``, ``y`` (base score, score without failure arcs) and ``n`` known words.  1: per block, ``a`` the rows that follow a
    failure arc, ``b`` the number of its state among those that the block fails from, by key, and ``c`` how often; ``d``, ``e`` are the counts of those
    states and of their shorter suffixes (0: none).  2: per block and range of hashes, ``a`` the keys of states; of the n-grams that the block
    owns ``b`` how many extend the state, ``c`` the sum of their counts, ``d`` of the counts of what they are without the first word; ``e``
    whether the block fails from the state.  States that it alone has and doesn't fail from are left out.
    """

    def read(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        block = table["block"][0].as_py()
        text = int(np.flatnonzero(kinds == 0)[0])
        tokens, first = _block_read(*(table[c][text].as_py() for c in "abc"))
        at, keys = _grams(tokens, first, bits)
        parts = table["part"].to_numpy()
        # Per order: a place where each distinct n-gram ends, its count, whether the block owns it or alone has it; and each place's n-gram.
        end, count, flags, number = {}, {}, {}, {}
        for order in (1, 2, 3):
            rows = np.flatnonzero(kinds == order)
            rows = rows[np.argsort(parts[rows])]
            where, starts, inverse = _grouped(keys[order])
            end[order] = at[order][where[starts]]
            count[order] = np.concatenate([np.zeros(0, np.int64), *(_unpacked(table["a"][int(r)].as_py(), np.int64) for r in rows)])
            flags[order] = np.concatenate([np.zeros(0, np.uint8), *(_unpacked(table["b"][int(r)].as_py(), np.uint8) for r in rows)])
            if order < 3:
                number[order] = np.zeros(len(tokens), np.int64)
                number[order][at[order]] = inverse
                name = keys[order][where[starts]]
                # A pair's name ends in 1, a word's in 0.
                names = name if order == 1 else np.concatenate([names, name | np.uint64(1)])
        del keys, where, inverse, at
        words, pairs, n = len(end[1]), len(end[2]), len(first) - 1
        base = np.log10((count[1] + 0.5) / denominator)

        # States, arcs and failure arcs.
        state = {1: lambda place: 1 + number[1][place], 2: lambda place: 1 + words + number[2][place]}
        size = np.concatenate([[0], count[1], count[2]])
        fail = np.zeros(1 + words + pairs, np.int64)
        fail[1 + words :] = state[1](end[2])
        arcs, logp, target = [np.arange(words)], [base], [np.where(count[1] > 0, 1 + np.arange(words), 0)]
        for order in (2, 3):
            in_model = count[order] > 0
            place = end[order][in_model]
            source = state[order - 1](place - 1)
            arcs.append((source << _WORD_BITS) | number[1][place])
            logp.append(np.log10((count[order][in_model] - off[order]) / size[source]))
            target.append(state[2](place))
        arcs, logp, target = (np.concatenate(x) for x in (arcs, logp, target))
        sort = np.argsort(arcs)
        score, rows, states = Automaton(arcs[sort], logp[sort], target[sort], fail).traverse(number[1], first)
        del arcs, logp, target, sort

        row = np.repeat(np.arange(n), np.diff(first))
        known = np.bincount(row, weights=count[1][number[1]] > 0, minlength=n)
        out = [dict(_at=np.arange(n), x=np.bincount(row, weights=base[number[1]], minlength=n), y=score, n=known, kind=np.zeros(n))]
        del row, score, known

        # The arcs that the block owns, summed by the state that they leave.
        sums = np.zeros((3, len(size)), np.int64)
        for order in (2, 3):
            own = np.flatnonzero((flags[order] & 1 == 1) & (count[order] > 0))
            place = end[order][own]
            source = state[order - 1](place - 1)
            shorter = count[order - 1][number[order - 1][place]]
            for i, weights in enumerate((None, count[order][own], shorter)):
                sums[i] += np.bincount(source, weights=weights, minlength=len(size)).astype(np.int64)
        failed = np.zeros(len(size), bool)
        failed[states] = True
        alone = np.concatenate([[2], flags[1], flags[2]]) > 1
        sent = np.flatnonzero(failed | ((sums[0] > 0) & ~alone))
        sent = sent[np.argsort(names[sent - 1])]
        found, asks = names[sent - 1], failed[sent]
        cuts = _cuts(found, ranges)
        some = [p for p in range(ranges) if cuts[p] < cuts[p + 1]]
        blobs = [[_packed(found[x], True), *(_packed(sums[i][sent[x]]) for i in range(3)), _packed(asks[x].astype(np.uint8))] for x in (slice(cuts[p], cuts[p + 1]) for p in some)]
        kinds = [2] * len(some)
        if len(states):
            followed, times = np.unique((rows << _WORD_BITS) | states, return_counts=True)
            sent = sent[asks]
            place = np.zeros(len(size), np.int32)
            place[sent] = np.arange(len(sent), dtype=np.int32)
            blobs.append([_packed((followed >> _WORD_BITS).astype(np.int32), True), _packed(place[followed & ((1 << _WORD_BITS) - 1)]), _packed(times.astype(np.int32)), _packed(size[sent]), _packed(np.where(fail[sent] > 0, size[fail[sent]], 0))])
            kinds.append(1)
            some.append(0)
        types = dict(kind=pa.int32(), part=pa.int32(), _at=pa.int32(), x=pa.float64(), y=pa.float64(), n=pa.int64(), **dict.fromkeys("abcde", pa.binary()))
        made = dict(kind=np.concatenate([np.zeros(n), kinds]), part=np.concatenate([np.zeros(n), some]))
        made |= {c: np.concatenate([out[0][c], np.zeros(len(some))]) for c in ("_at", "x", "y", "n")}
        made |= {c: [None] * n + [blob[i] for blob in blobs] for i, c in enumerate("abcde")}
        columns = {c: pa.array(made[c], t) if c in "abcde" else pa.array(made[c].astype(t.to_pandas_dtype())) for c, t in types.items()}
        return pa.table({"block": pa.array(np.full(n + len(some), block)), **columns})

    payload = texts.select(F.lit(0).alias("kind"), "block", F.lit(0).alias("part"), "a", "b", "c")
    answers = told.select("kind", "block", "part", "a", "b", F.lit(None).cast("binary").alias("c"))
    schema = "block bigint, kind int, part int, _at int, x double, y double, n bigint, a binary, b binary, c binary, d binary, e binary"
    return payload.unionByName(answers).groupBy("block").applyInArrow(read, schema)


def _extended(found: DataFrame) -> DataFrame:
    """Per block and range of hashes, for the states that the block fails from: ``a``, ``b``, ``c`` as in kind 2 of :func:`_read`, over all blocks."""

    def answer(table: pa.Table) -> pa.Table:
        def column(name, dtype, ascending=False):
            return [_unpacked(x.as_py(), dtype, ascending) for x in table[name]]

        asks = column("e", np.uint8)
        sizes = np.cumsum([0, *map(len, asks)])
        order, starts, inverse = _grouped(np.concatenate(column("a", np.uint64, True)))
        asked = np.concatenate(asks) > 0
        before = np.concatenate([[0], np.cumsum(asked)])[sizes]
        rows = np.flatnonzero(np.diff(before))
        out = {"block": table["block"].take(rows), "part": table["part"].take(rows)}
        for name, values in zip("abc", "bcd"):
            total = np.add.reduceat(np.concatenate(column(values, np.int64))[order], starts)[inverse[asked]]
            out[name] = pa.array([_packed(total[before[i] : before[i + 1]]) for i in rows], pa.binary())
        return pa.table(out)

    states = found.where("kind = 2").select("block", "part", "a", "b", "c", "d", "e")
    return states.groupBy("part").applyInArrow(answer, "block bigint, part int, a binary, b binary, c binary")


def _failures(found: DataFrame, extended: DataFrame, off: dict[int, float], denominator: float) -> DataFrame:
    """Per row of a block that follows failure arcs: ``_back``, the sum of their log10 weights."""

    def weigh(table: pa.Table) -> pa.Table:
        kinds, parts = table["kind"].to_numpy(), table["part"].to_numpy()
        answers = np.flatnonzero(kinds == 2)
        answers = answers[np.argsort(parts[answers])]
        n, u, l = (np.concatenate([_unpacked(table[c][int(i)].as_py(), np.int64) for i in answers]) for c in "abc")
        own = int(np.flatnonzero(kinds == 1)[0])
        rows, state, times = (_unpacked(table[c][own].as_py(), np.int32, c == "a") for c in "abc")
        count, shorter = (_unpacked(table[c][own].as_py(), np.int64) for c in "de")
        pair = shorter > 0
        used = (u - np.where(pair, off[3], off[2]) * n) / count
        below = np.where(pair, (l - off[2] * n) / np.maximum(shorter, 1), (l + 0.5 * n) / denominator)
        weight = np.log10(np.maximum(1 - used, 1e-12) / np.maximum(1 - below, 1e-12))
        at, place = np.unique(rows, return_inverse=True)
        return pa.table({"block": table["block"].take(np.zeros(len(at), np.int64)), "_at": pa.array(at), "_back": pa.array(np.bincount(place, weights=weight[state] * times))})

    none = F.lit(None).cast("binary")
    rows = found.where("kind = 1").select("block", "kind", "part", "a", "b", "c", "d", "e")
    answers = extended.select("block", F.lit(2).alias("kind"), "part", "a", "b", "c", none.alias("d"), none.alias("e"))
    return rows.unionByName(answers).groupBy("block").applyInArrow(weigh, "block bigint, _at int, _back double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are runs of other than ASCII white space, after lower-casing A-Z, then one end.  A null text is empty: the end alone.  The model
    learns from the documents that :func:`held_out` doesn't keep back; without any, every token has probability 1.  Rows may repeat; other
    columns are ignored.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    held = written(_blocks(docs, id_col, text_col, block), "lm-blocks")
    texts = held.where("_at IS NULL").select("block", "a", "b", "c", "d")
    bits = key_bits(size)
    parts = 1 + size // RANGE_BYTES
    told = written(_told(_asked(texts, parts, bits)), "lm-counts")
    sums = {r["kind"]: r for r in told.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("tokens", "types", "once", "twice"))).collect()}
    total, vocabulary = (sums[1]["tokens"], sums[1]["types"]) if sums else (0, 0)
    off = {n: discount(sums[n]["once"], sums[n]["twice"]) if n in sums else DISCOUNTS[0] for n in (2, 3)}
    denominator = float(total + 0.5 * (vocabulary + 1))
    found = written(_read(texts, told, off, denominator, bits, parts), "lm-scores")
    back = _failures(found, _extended(found), off, denominator)
    read = found.where("kind = 0").select("block", "_at", "x", "y", F.col("n").alias("n_known"))
    out = held.where("_at IS NOT NULL").select("_id", "held_out", F.col("_at").cast("int").alias("_at"), "n_tokens", "block").join(read, ["block", "_at"]).join(back, ["block", "_at"], "left")
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("x").alias("base_score"), (F.col("y") + F.coalesce("_back", F.lit(0.0))).alias("score"))
