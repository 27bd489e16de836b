"""Weighted acyclic automata over words: counts of sequences of up to three words in a compact, mergeable form.

An automaton has a root and two layers of states. An arc carries a word, the weight of the sequence that ends with
it (0 where that is only a prefix) and its target. States with the same arcs are one state. Words are numbers, their
places in an alphabet in byte order that travels beside the arcs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

NONE = -1
_INNER = np.dtype([("word", "<i4"), ("weight", "<i8"), ("state", "<i4")])
_LAST = np.dtype([("word", "<i4"), ("weight", "<i8")])


def in_order(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of three word numbers (``NONE`` behind the last word) in order, each once, with the sum of its weights.

    Without weights each row weighs 1.
    """
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    bits = int(grams.max() + 2).bit_length()
    if 3 * bits > 63:
        order = np.lexsort(grams.T[::-1])
        grams = grams[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(grams, axis=0) != 0).any(axis=1)])
        return grams[edge], np.add.reduceat(np.ones(len(order), np.int64) if weights is None else weights[order], edge)
    key = np.zeros(len(grams), np.int64)
    for column in range(3):
        key <<= bits
        key += grams[:, column] + 1
    if weights is None:
        key.sort()
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.diff(edge, append=len(key))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(weights[order], edge)
    key = key[edge]
    out = np.empty((len(key), 3), np.int32)
    for column in (2, 1, 0):
        out[:, column] = (key & ((1 << bits) - 1)) - 1
        key >>= bits
    return out, sums


def _register(arcs: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state of each owner, arcs of the states, number of arcs of each state): equal arcs make one state."""
    if not len(arcs):
        return np.zeros(owners, np.int32), arcs, np.zeros(1, np.int64)
    cuts = np.searchsorted(owner, np.arange(owners + 1)) * arcs.dtype.itemsize
    raw, known = arcs.tobytes(), {}
    state = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())), np.int32, owners)
    sizes = np.fromiter((len(x) // arcs.dtype.itemsize for x in known), np.int64, len(known))
    return state, np.frombuffer(b"".join(known), arcs.dtype), sizes


def _dumped(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0 on, each in as few bytes a number as its largest needs."""
    packed = []
    for x in columns:
        largest = int(x.max()) if len(x) else 0
        packed.append(x.astype(f"<u{next(size for size in (1, 2, 4, 8) if largest < 1 << (8 * size))}"))
    header = [n for x in packed for n in (x.itemsize, len(x))]
    return np.array(header, "<i8").tobytes() + b"".join(x.tobytes() for x in packed)


def _loaded(blob: bytes, columns: int) -> list[np.ndarray]:
    at, out = 16 * columns, []
    for size, n in np.frombuffer(blob, "<i8", 2 * columns).reshape(-1, 2).tolist():
        out.append(np.frombuffer(blob, f"<u{size}", n, at).astype(np.int64))
        at += size * n
    return out


def build(grams: np.ndarray, weights: np.ndarray) -> bytes:
    """The automaton of rows as ``in_order`` gives them, built from the last words to the first."""
    two, three = grams[:, 1] >= 0, grams[:, 2] >= 0
    pair = np.cumsum(np.r_[True, (np.diff(grams[:, :2], axis=0) != 0).any(axis=1)][:len(grams)]) - 1
    head = np.cumsum(np.r_[True, np.diff(grams[:, 0]) != 0][:len(grams)]) - 1

    last = np.empty(int(three.sum()), _LAST)
    last["word"], last["weight"] = grams[three, 2], weights[three]
    pairs = int(pair[-1]) + 1 if len(grams) else 0
    after_pair, last, last_sizes = _register(last, pair[three], pairs)

    first_of_pair = np.searchsorted(pair, np.arange(pairs))
    is_pair = two[first_of_pair]
    inner = np.empty(int(is_pair.sum()), _INNER)
    at = first_of_pair[is_pair]
    inner["word"], inner["state"] = grams[at, 1], after_pair[is_pair]
    inner["weight"] = np.where(three[at], 0, weights[at])
    heads = int(head[-1]) + 1 if len(grams) else 0
    after_head, inner, inner_sizes = _register(inner, head[at], heads)

    at = np.searchsorted(head, np.arange(heads))
    root = np.empty(heads, _INNER)
    root["word"], root["state"] = grams[at, 0], after_head
    root["weight"] = np.where(two[at], 0, weights[at])
    return _dumped([root["word"], root["weight"], root["state"], inner["word"], inner["weight"], inner["state"], inner_sizes,
                    last["word"], last["weight"], last_sizes])


def rows(automaton: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of weight above 0, those of one word first, and their weights."""
    head, head_weight, state, inner, inner_weight, inner_state, inner_sizes, last, last_weight, last_sizes = _loaded(automaton, 10)
    of_root, arc = _arcs(state, inner_sizes)
    of_arc, end = _arcs(inner_state[arc], last_sizes)
    levels = [
        (head, None, None, head_weight),
        (head[of_root], inner[arc], None, inner_weight[arc]),
        (head[of_root[of_arc]], inner[arc[of_arc]], last[end], last_weight[end]),
    ]
    grams, weights = [], []
    for *words, weight in levels:
        keep = weight > 0
        gram = np.full((int(keep.sum()), 3), NONE, np.int32)
        for i, w in enumerate(words):
            if w is not None:
                gram[:, i] = w[keep]
        grams.append(gram)
        weights.append(weight[keep])
    return np.concatenate(grams), np.concatenate(weights)


def _arcs(states: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``states``, arc) for all arcs of each of the states."""
    size, start = sizes[states], (np.cumsum(sizes) - sizes)[states]
    of = np.repeat(np.arange(len(states)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def restricted(alphabet: pa.Array, grams: np.ndarray, weights: np.ndarray) -> tuple[pa.Array, bytes]:
    """(words, automaton) of sequences in order, with those words of an ordered alphabet that they need."""
    used = np.unique(grams)
    used = used[used >= 0]
    # Numbers keep their order, and so do the sequences.
    local = np.where(grams >= 0, np.searchsorted(used, grams), NONE).astype(np.int32)
    return alphabet.take(pa.array(used)), build(local, weights)


def united(alphabets: pa.ListArray, automata: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, sequences, weights): the union of automata, each with its alphabet; weights are summed."""
    words = alphabets.flatten()
    coded = words.dictionary_encode()
    by = pa.compute.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by), dtype=np.int32)
    number = place[coded.indices.to_numpy()]
    starts = np.concatenate([[0], np.cumsum(alphabets.value_lengths().to_numpy(zero_copy_only=False))])
    grams, weights = [np.zeros((0, 3), np.int32)], [np.zeros(0, np.int64)]
    for start, automaton in zip(starts.tolist(), automata):
        own, weight = rows(automaton)
        grams.append(np.where(own >= 0, number[np.maximum(own, 0) + start] if len(own) else own, NONE).astype(np.int32))
        weights.append(weight)
    return (coded.dictionary.take(pa.array(by)), *in_order(np.concatenate(grams), np.concatenate(weights)))


def composed(asked: tuple[np.ndarray, np.ndarray], counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of the first automaton's rows with the weights that the second one gives them, 0 if none."""
    (grams, _), (known, weights) = asked, counted
    both, sums = in_order(np.concatenate([grams, known]), np.concatenate([np.zeros(len(grams), np.int64), weights]))
    wanted, mark = in_order(np.concatenate([grams, known]), np.concatenate([np.ones(len(grams), np.int64), np.zeros(len(known), np.int64)]))
    return both[mark > 0], sums[mark > 0]
