"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation of a text into pieces maximises a sum of piece scores, so it is a product of
max-plus matrices. A long document is split into chunks; a chunk's matrix gives the best score from
"the first i characters belong to a piece of the chunk before" to "the last piece reaches j
characters into the next chunk". The matrices of a document are combined associatively, which fixes
the states at the chunk borders, and every chunk is then traced back on its own. Scores are whole
numbers, so the sums are the same in any order.

Within a chunk, a blank that follows another character always starts a piece, so only the parts
before the first and after the last such place depend on the border states (the matrix has rank one
in the max-plus sense); a chunk without such a place gets the full matrix.

Everything between two such places is a unit that is cut on its own. Texts are taken some millions of
characters at a time: their distinct units are cut together, position by position over all units of
similar length, and every unit of the texts then takes the ids of its distinct one.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.session import materialize, ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16384
BLANK = "▁"
#: A blank mark that a text holds itself is written as the first and second of these characters, the
#: first one alone as itself twice; neither is in a piece, so both become bytes.
ESCAPE, MARKED = "\ue000", "\ue001"
SCALE = 1 << 20
LOWEST = -(1 << 60)
#: Characters whose units are cut together, cells of a block of units, and the fewest units of similar
#: length that are cut as a block.
AT_ONCE = 1 << 22
CELLS = 1 << 18
FEW = 64

_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_ESCAPED = re.compile(f"{ESCAPE}([{ESCAPE}{MARKED}])")
_BORDER = re.compile(f"(?<=[^{BLANK}]){BLANK}")


@dataclass
class Trie:
    """The piece table as arrays: nodes are prefixes of pieces, 0 the empty one. The child of ``node``
    by a character of number ``c`` is ``child[base[node] + c]`` where ``owner`` there is ``node``."""

    number: np.ndarray  # of a code point; 0: in no piece
    base: np.ndarray
    owner: np.ndarray
    child: np.ndarray
    piece: np.ndarray  # id of the node's piece or -1
    value: np.ndarray


@dataclass
class Pieces:
    """A piece table: prefix of a piece -> (id or -1, score), byte ids, and the longest piece."""

    table: dict[str, tuple[int, int]]
    byte_ids: list[int]
    strings: list[str]
    longest: int
    unknown: int

    @cached_property
    def trie(self) -> Trie:
        return trie_of(self.table)


def read_pieces(model_file: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of a model file; kind is piece, byte or control."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: (
        "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else "piece"
    )
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())]


def build(pieces: list[tuple[str, float, str]]) -> Pieces:
    """Scores of a table whose scores are log-probabilities are kept; one whose scores are merge
    ranks (whole numbers from 0 down) gets log-probabilities by Zipf's law of the rank."""
    real = [(i, p, s) for i, (p, s, k) in enumerate(pieces) if k == "piece"]
    ranked = all(s == int(s) for _, _, s in real)
    worst = min(s for _, _, s in real if s > -1e8)
    table: dict[str, tuple[int, int]] = {}
    for i, piece, score in real:
        if any(c == BLANK for c in piece.lstrip(BLANK)):
            raise ValueError("a piece with a blank after another character is not supported")
        score = max(score, worst - 1)
        value = round((-math.log(2 - score) - math.log(math.log(len(pieces))) if ranked else score) * SCALE)
        table[piece] = (i, value)
    lowest = min(v for _, v in table.values())
    for piece in list(table):
        for k in range(1, len(piece)):
            table.setdefault(piece[:k], (-1, 0))
    byte_ids = [i for i, (_, _, k) in enumerate(pieces) if k == "byte"]
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    longest = max(len(p) for _, p, _ in real)
    return Pieces(table, byte_ids, [p for p, _, _ in pieces], longest, lowest - 10 * SCALE)


def trie_of(table: dict[str, tuple[int, int]]) -> Trie:
    """Bases are the first that fit, nodes with many children first; an only child takes any free slot."""
    letters = {c: k for k, c in enumerate(sorted({t[-1] for t in table}), 1)}
    number = np.zeros(0x110000, np.int64)
    number[[ord(c) for c in letters]] = list(letters.values())
    node = {"": 0, **{t: k for k, t in enumerate(table, 1)}}
    below: dict[int, list[tuple[int, int]]] = defaultdict(list)
    piece, value = np.full(len(node), -1, np.int32), np.zeros(len(node), np.int64)
    for t, (known, v) in table.items():
        below[node[t[:-1]]].append((letters[t[-1]], node[t]))
        piece[node[t]], value[node[t]] = known, v
    base, at = np.zeros(len(node), np.int64), 0
    reach = len(letters) + 1
    owner = np.full(2 * len(node) + reach, -1, np.int64)
    child = np.zeros(len(owner), np.int64)
    for parent, children in sorted(below.items(), key=lambda x: -len(x[1])):
        if len(children) == 1:
            break
        by, to = np.array(children).T
        while (owner[at + by] >= 0).any():
            at += 1
            if at + reach > len(owner):
                owner = np.append(owner, np.full(len(owner), -1))
                child = np.append(child, np.zeros(len(child), np.int64))
        base[parent], owner[at + by], child[at + by] = at, parent, to
    only = [(parent, *x[0]) for parent, x in below.items() if len(x) == 1]
    if only:
        parent, by, to = np.array(only).T
        owner = np.append(owner, np.full(len(only), -1))
        child = np.append(child, np.zeros(len(only), np.int64))
        slot = reach + np.flatnonzero(owner[reach:] < 0)[: len(only)]
        base[parent], owner[slot], child[slot] = slot - by, parent, to
    # a base is at most the last slot: every character's slot is in the arrays
    owner = np.append(owner, np.full(reach, -1))
    return Trie(number, base, owner, np.append(child, np.zeros(reach, np.int64)), piece, value)


def normalized(text: str) -> str:
    """Blanks as blank marks, one in front; literal blank marks are told apart."""
    if not text:
        return ""
    if ESCAPE in text:
        text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    if BLANK in text:
        text = text.replace(BLANK, ESCAPE + MARKED)
    return BLANK + text.replace(" ", BLANK)


def _arcs(p: Pieces, text: str, at: int) -> Iterator[tuple[int, int, int]]:
    """(end, id or -1 for a character without a piece, score) of everything that starts at ``at``."""
    single = False
    for end in range(at + 1, min(len(text), at + p.longest) + 1):
        found = p.table.get(text[at:end])
        if found is None:
            break
        if found[0] >= 0:
            single |= end == at + 1
            yield end, found[0], found[1]
    if not single:
        yield at + 1, -1, p.unknown


def best_path(p: Pieces, text: str, start: int, stop: int) -> tuple[int, list[int]]:
    """Best score and ids of the pieces that cut text[start:stop]; ties go to the later start."""
    score = [LOWEST] * (stop + 1)
    score[start] = 0
    back: list[tuple[int, int]] = [(0, 0)] * (stop + 1)
    for at in range(start, stop):
        here = score[at]
        if here == LOWEST:
            continue
        for end, piece, value in _arcs(p, text, at):
            if end <= stop and here + value >= score[end]:
                score[end], back[end] = here + value, (at, piece)
    ids: list[int] = []
    at = stop
    while at > start:
        before, piece = back[at]
        if piece >= 0:
            ids.append(piece)
        else:
            ids.extend(p.byte_ids[b] for b in reversed(text[before:at].encode("utf-8", "surrogatepass")))
        at = before
    ids.reverse()
    return score[stop], ids


def unit_path(p: Pieces, unit: str) -> tuple[int, list[int]]:
    """:func:`best_path` of a whole unit: the same recursion without border states, where every
    position is reached."""
    n, get, longest, unknown = len(unit), p.table.get, p.longest, p.unknown
    score = [LOWEST] * (n + 1)
    score[0] = 0
    source, piece = [0] * (n + 1), [-1] * (n + 1)
    for at in range(n):
        here, single = score[at], False
        for end in range(at + 1, min(n, at + longest) + 1):
            found = get(unit[at:end])
            if found is None:
                break
            known, value = found
            if known >= 0:
                if end == at + 1:
                    single = True
                value += here
                if value >= score[end]:
                    score[end], source[end], piece[end] = value, at, known
        if not single and here + unknown >= score[at + 1]:
            score[at + 1], source[at + 1], piece[at + 1] = here + unknown, at, -1
    ids: list[int] = []
    at = n
    while at:
        before = source[at]
        if piece[at] >= 0:
            ids.append(piece[at])
        else:
            ids.extend(p.byte_ids[b] for b in reversed(unit[before:at].encode("utf-8", "surrogatepass")))
        at = before
    ids.reverse()
    return score[n], ids


def encode_units(p: Pieces, text: str) -> tuple[int, list[int]]:
    """Score and ids of a text that starts and ends at piece borders."""
    total, ids = 0, []
    for unit in _UNITS.findall(text):
        score, path = unit_path(p, unit)
        total += score
        ids.extend(path)
    return total, ids


def _block_paths(p: Pieces, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`unit_path` of many units: (ids of all units, one after the other; number of each's ids).

    ``letters`` are code points by [unit, position], 0 behind a unit's end; ``sizes`` do not rise."""
    t = p.trie
    n, width = letters.shape
    number = np.ascontiguousarray(t.number[letters].T)
    number[np.arange(width)[:, None] >= sizes] = 0  # no piece reaches beyond its unit
    score = np.full((width + 1, n), LOWEST, np.int64)
    score[0] = 0
    source, piece = np.zeros(score.shape, np.int32), np.full(score.shape, -1, np.int32)

    def offer(at: int, end: int, who: np.ndarray, known, value) -> None:
        value = score[at, who] + value
        better = value >= score[end, who]
        who = who[better]
        score[end, who], source[end, who] = value[better], at
        piece[end, who] = known if np.isscalar(known) else known[better]

    for at in range(width):
        alive = int(np.searchsorted(-sizes, -at))  # units with more than ``at`` characters
        who, node, end = np.arange(alive), np.zeros(alive, np.int64), at
        single = np.zeros(alive, bool)
        while end < width:
            slot = t.base[node] + number[end, who]
            found = t.owner[slot] == node
            who, node = who[found], t.child[slot[found]]
            end += 1
            if not who.size:
                break
            known = t.piece[node]
            whole = known >= 0
            if end == at + 1:
                single[who[whole]] = True
            offer(at, end, who[whole], known[whole], t.value[node[whole]])
        offer(at, at + 1, np.flatnonzero(~single), -1, p.unknown)

    path = np.full((n, width), -2, np.int32)  # by the pieces' starts; -2 where none starts
    who, at = np.arange(n), sizes.astype(np.int64)
    while who.size:
        known, at = piece[at, who], source[at, who]
        path[who, at] = known
        who, at = who[at > 0], at[at > 0]
    unit, at = np.nonzero(path != -2)
    ids, count = path[unit, at], np.ones(len(unit), np.int64)
    bare = np.flatnonzero(ids == -1)
    if bare.size:
        c = letters[unit[bare], at[bare]]
        count[bare] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(ids, count)
        raw = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        ids[ids == -1] = np.array(p.byte_ids, np.int32)[np.frombuffer(raw, np.uint8)]
    return ids, np.bincount(unit, count, n).astype(np.int64)


def _distinct_paths(p: Pieces, letters: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """The ids of units; unit k is letters[offsets[k] : offsets[k + 1]], none is empty."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    ids, counts = [], []
    at = 0
    while at < len(order):
        width = int(sizes[order[at]])
        some = order[at : at + max(CELLS // width, 1)]
        if len(some) < FEW or 2 * sizes[some[FEW - 1]] < width:
            some = some[:1]
            k = offsets[some[0]]
            unit = letters[k : k + width].tobytes().decode("utf-32-le", "surrogatepass")
            path = unit_path(p, unit)[1]
            ids.append(np.array(path, np.int32))
            counts.append(np.array([len(path)]))
        else:
            inside = np.arange(width) < sizes[some][:, None]
            where = np.where(inside, offsets[some][:, None] + np.arange(width), 0)
            path, count = _block_paths(p, np.where(inside, letters[where], 0), sizes[some])
            ids.append(path)
            counts.append(count)
        at += len(some)
    ends = np.concatenate([[0], *counts]).cumsum()
    solved = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
    return solved.take(pa.array(np.argsort(order)))


def encode_texts(p: Pieces, texts: list[str]) -> pa.ListArray:
    """The ids of :func:`encode_units` of every text."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(letters):
        return pa.array([[] for _ in texts], pa.list_(pa.int32()))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    blank = letters == ord(BLANK)
    border = blank.copy()
    border[1:] &= ~blank[:-1]
    border[first[first < len(letters)]] = True
    starts = np.flatnonzero(border)
    offsets = pa.py_buffer(np.append(starts, len(letters)) * 4)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(letters)])
    units = units.dictionary_encode()
    _, distinct, data = units.dictionary.buffers()
    distinct = np.frombuffer(distinct, np.int64)[: len(units.dictionary) + 1] // 4
    ids = _distinct_paths(p, np.frombuffer(data, "<u4"), distinct).take(units.indices)
    at = ids.offsets.to_numpy()[np.searchsorted(starts, first)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.values)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts in ``column`` have about ``AT_ONCE`` characters at most."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if start < stop:
            yield batch.slice(start, stop - start)


def chunks_of(p: Pieces, text: str, size: int) -> list[tuple[str, int]]:
    """(chunk with the characters that a piece may reach beyond it, own length) of a long text."""
    return [(text[k : k + size + p.longest - 1], min(size, len(text) - k)) for k in range(0, len(text), size)]


def _inner(p: Pieces, text: str, own: int) -> tuple[int, int] | None:
    """The first border that no border state can jump over, and the last one in the chunk."""
    first = _BORDER.search(text, p.longest)
    if not first or first.start() >= own:
        return None
    last = first.start()
    for found in _BORDER.finditer(text, max(p.longest, own - 4096), own):
        last = max(last, found.start())
    return first.start(), last


def _full(p: Pieces, text: str, start: int, own: int, states: int) -> tuple[np.ndarray, np.ndarray]:
    """[entry state, exit state] best scores over text[start:own], exits up to ``states - 1`` beyond,
    and the order of the entry states of every exit: the backtrace, which takes the latest start
    among equal scores, prefers the higher one."""
    width = p.longest
    best = np.full((len(text) + 1, states), LOWEST, np.int64)
    # the last piece's start, -1 where an entry state itself stands, and the order at that start
    source = np.full(best.shape, -1, np.int64)
    order, order_at_source = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
    for i in range(min(states, len(text) - start + 1)):
        best[start + i, i] = 0

    def settle(at: int) -> None:
        if states > 1:
            order[at, np.lexsort((order_at_source[at], source[at]))] = np.arange(states)

    for at in range(start, own):
        row = best[at]
        alive = row > LOWEST
        if alive.any():
            settle(at)
            for end, _, value in _arcs(p, text, at):
                better = alive & (row + value >= best[end])
                best[end, better] = row[better] + value
                source[end, better] = at
                order_at_source[end, better] = order[at, better]
    out, orders = np.full((states, width), LOWEST, np.int64), np.zeros((states, width), np.int64)
    reach = min(width, len(text) - own + 1)
    for at in range(own, own + reach):
        settle(at)
    out[:, :reach] = best[own : own + reach].T
    orders[:, :reach] = order[own : own + reach].T
    return out, orders


def ordered_transfer(p: Pieces, text: str, own: int, scored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's max-plus matrix: entry state (characters used already) x exit state, and the order
    of the entry states for equal scores.

    The border states of the best path do not change if a constant is added to a matrix, so what
    every path through the chunk has in common is left out, unless ``scored`` asks for true scores.
    """
    inner = _inner(p, text, own)
    if inner is None:
        return _full(p, text, 0, own, p.longest)
    first, last = inner
    # all paths meet at the first border, so their order there is the order at every exit
    enter, orders = (m[:, :1] for m in _full(p, text[:first], 0, first, p.longest))
    leave = _full(p, text, last, own, 1)[0]
    middle = encode_units(p, text[first:last])[0] if scored else 0
    matrix = np.where((enter > LOWEST) & (leave > LOWEST), enter + middle + leave, LOWEST)
    return matrix, np.broadcast_to(orders, matrix.shape)


def transfer(p: Pieces, text: str, own: int, scored: bool = False) -> np.ndarray:
    """The matrix of :func:`ordered_transfer`."""
    return ordered_transfer(p, text, own, scored)[0]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    sums = a[:, :, None] + b[None, :, :]
    sums[(a[:, :, None] <= LOWEST) | (b[None, :, :] <= LOWEST)] = LOWEST
    return sums.max(axis=1)


def border_states(matrices: list[np.ndarray], orders: list[np.ndarray] | None = None) -> list[int]:
    """The state at each of the chunks' borders on the best path, from 0 at the start to 0 at the end.

    With ``orders``, equal scores give the path that the backtrace of the whole text takes."""
    reach = [matrices[0][:1]]
    for m in matrices[1:]:
        reach.append(product(reach[-1], m))
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        scores = reach[k - 1][0].copy()
        onward = matrices[k][:, states[-1]]
        dead = (scores <= LOWEST) | (onward <= LOWEST)
        scores = scores + onward
        scores[dead] = LOWEST
        ties = np.flatnonzero(scores == scores.max())
        states.append(int(ties[0] if orders is None else ties[orders[k][ties, states[-1]].argmax()]))
    return [0, *reversed(states)]


def ends(p: Pieces, text: str, own: int, enter: int, leave: int) -> tuple[list[int], str, list[int]]:
    """What :func:`trace` joins: the ids up to the first border that no state can jump over, the text
    to the last one, and the ids from there on."""
    inner = _inner(p, text, own)
    if inner is None:
        return best_path(p, text, enter, own + leave)[1], "", []
    first, last = inner
    tail = text[last : own + leave]
    return best_path(p, text, enter, first)[1], text[first:last], best_path(p, tail, 0, len(tail))[1]


def trace(p: Pieces, text: str, own: int, enter: int, leave: int) -> list[int]:
    """Ids of the pieces that start in the chunk, between two border states."""
    head, middle, tail = ends(p, text, own, enter, leave)
    return head + encode_units(p, middle)[1] + tail


def decode(p: Pieces, ids: Iterable[int]) -> str:
    """The text of a piece sequence: the inverse of encoding for every text."""
    first_byte = p.byte_ids[0]
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if first_byte <= i < first_byte + 256:
            raw.append(i - first_byte)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(p.strings[i].replace(BLANK, " "))
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out)[1:]
    return _ESCAPED.sub(lambda m: BLANK if m[1] == MARKED else ESCAPE, text) if ESCAPE in text else text


_BUILT: dict[str, Pieces] = {}


def _pieces(shared) -> Pieces:
    """The table of a broadcast, built once per worker."""
    name, pieces = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(pieces)
    return _BUILT[name]


def share(spark: SparkSession, model_file: str = MODEL):
    """The piece table as a broadcast: its size is the vocabulary's, whatever the input."""
    ship_package(spark)
    return spark.sparkContext.broadcast((uuid.uuid4().hex, read_pieces(model_file)))


def encode(df: DataFrame, shared, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, ids (array<int>): one row per row of ``df``; null and empty texts have no ids.

    Texts up to ``chunk`` characters are encoded where they are read. Longer ones are chunked: the
    chunks are spread over the cluster twice (matrices, traces), only matrices and states are
    grouped by document. Keys may repeat or be null. Other columns are not read.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > F.lit(chunk)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for batch in batches:
            for part in slices(batch, 1):
                ids = encode_texts(p, [normalized(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for batch in batches:
            for k in range(batch.num_rows):
                cut = chunks_of(p, normalized(batch.column(1)[k].as_py()), chunk)
                name = uuid.uuid4().hex  # rows may repeat a key; written once below
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(k, 1)] * len(cut)),
                        pa.array([name] * len(cut)),
                        pa.array(range(len(cut)), pa.int32()),
                        pa.array([t for t, _ in cut]),
                        pa.array([n for _, n in cut], pa.int32()),
                    ],
                    names=["key", "row", "n", "chunk", "own"],
                )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for batch in batches:
            made = [
                np.stack(ordered_transfer(p, t.as_py(), n.as_py())).tobytes()
                for t, n in zip(batch.column(3), batch.column(4))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(made, pa.binary())], names=["row", "n", "matrix"]
            )

    def states(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        width = _pieces(shared).longest
        cut = [np.frombuffer(m.as_py(), np.int64).reshape(2, width, width) for m in group.column("matrix")]
        at = border_states([m for m, _ in cut], [o for _, o in cut])
        return pa.table(
            {
                "row": group.column("row"),
                "n": group.column("n"),
                "enter": pa.array(at[:-1], pa.int32()),
                "leave": pa.array(at[1:], pa.int32()),
            }
        )

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(shared)
        for batch in batches:
            for part in slices(batch, 3):
                key_, row, n, *cut_ = part.columns
                heads, middles, tails = zip(*(ends(p, *at) for at in zip(*(c.to_pylist() for c in cut_))))
                inner = encode_texts(p, middles)
                ids = [
                    np.concatenate([h, m.values, t], dtype=np.int32, casting="unsafe")
                    for h, m, t in zip(heads, inner, tails)
                ]
                yield pa.RecordBatch.from_arrays(
                    [key_, row, n, pa.array(ids, pa.list_(pa.int32()))], names=["key", "row", "n", "ids"]
                )

    direct = rows.filter(~long).mapInArrow(short, f"key {key_type}, ids array<int>")
    cut = materialize(
        rows.filter(long).mapInArrow(split, f"key {key_type}, row string, n int, chunk string, own int")
    )
    spread = cut.repartition("row", "n")
    borders = (
        spread.mapInArrow(matrices, "row string, n int, matrix binary")
        .groupBy("row")
        .applyInArrow(states, "row string, n int, enter int, leave int")
    )
    # every chunk has its borders; a left join adds no filter, so both uses share one shuffle of the texts
    traced = (
        spread.join(borders, ["row", "n"], "left")
        .select("key", "row", "n", "chunk", "own", "enter", "leave")
        .mapInArrow(traces, f"key {key_type}, row string, n int, ids array<int>")
    )
    joined = traced.groupBy("row").agg(
        F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("parts")
    )
    whole = joined.select("key", F.flatten(F.col("parts.ids")).alias("ids"))
    return direct.unionByName(whole).withColumnRenamed("key", key)


def decode_rows(df: DataFrame, shared, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in a new column ``out``; null ids give null."""
    if out in df.columns:
        raise ValueError(f"the column {out} exists")

    @F.pandas_udf("string")
    def decoded(values):
        p = _pieces(shared)
        return values.map(lambda v: None if v is None else decode(p, v))

    # evaluated once even where a filter uses it
    return df.withColumn(out, decoded.asNondeterministic()(F.col(ids)))
