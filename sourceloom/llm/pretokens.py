"""The pre-token pattern of byte-level vocabularies as a deterministic transducer.

The pattern  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+  (L letters, N numbers, O the rest)
looks at most two characters ahead, so a machine of twelve states over twelve classes of characters
can mark every border with a delay of one character. A chunk of text is then a map from states to
states; maps compose associatively, and a parallel prefix scan gives each chunk its start state.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import pack_table, unpack_table

# Classes of characters.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STMD, R, E, V, LL, END = range(12)
N_CLASSES = 12
LETTERS = (LETTER, STMD, R, E, V, LL)

# States. W: white space, 1 or more; S or O: the last one is U+0020 or another.
(S_START, S_LETTER, S_NUMBER, S_OTHER, S_W1S, S_W1O, S_WNS, S_WNO, S_QUOTE, S_QR, S_QV, S_QL) = range(12)
N_STATES = 12

#: Code point that stands for the end of a text, one past the last real one.
END_POINT = 0x110000


def _fresh(c: int) -> int:
    """The state of a pre-token that begins with class c."""
    if c in LETTERS:
        return S_LETTER
    return {NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_W1S, WHITE: S_W1O, QUOTE: S_QUOTE, END: S_START}[c]


def _step(q: int, c: int) -> tuple[int, bool, bool]:
    """Next state; border before this character; border before the previous one."""
    white = {SPACE: S_WNS, WHITE: S_WNO}
    body = S_LETTER if c in LETTERS else {NUMBER: S_NUMBER, OTHER: S_OTHER, QUOTE: S_OTHER}.get(c)
    if q == S_LETTER and c in LETTERS or q == S_NUMBER and c == NUMBER or q == S_OTHER and c in (OTHER, QUOTE):
        return q, False, False
    if q in (S_W1S, S_W1O, S_WNS, S_WNO) and c in white:
        return white[c], False, False
    if q == S_W1S and body is not None:
        return body, False, False
    if q == S_WNS and body is not None:
        return body, False, True
    if q == S_WNO and c != END:
        return _fresh(c), True, True
    if q == S_QUOTE:
        if c == STMD:
            return S_START, False, False
        if c in (R, V, LL):
            return {R: S_QR, V: S_QV, LL: S_QL}[c], False, False
        if c in (OTHER, QUOTE):
            return S_OTHER, False, False
    if q in (S_QR, S_QV, S_QL):
        if c == {S_QR: E, S_QV: E, S_QL: LL}[q]:
            return S_START, False, False
        return (S_LETTER, False, True) if c in LETTERS else (_fresh(c), True, True)
    return _fresh(c), True, False


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables over state * N_CLASSES + class: next state, and border bits (1: here, 2: one before)."""
    steps = [_step(q, c) for q in range(N_STATES) for c in range(N_CLASSES)]
    return np.array([s[0] for s in steps], np.uint8), np.array([s[1] + 2 * s[2] for s in steps], np.uint8)


def class_table(letters: str, numbers: str, spaces: str) -> np.ndarray:
    """Class of every code point, from the members of L, N and \\s as the tokenizer's library has them."""
    table = np.full(END_POINT + 1, OTHER, np.uint8)
    for members, c in ((letters, LETTER), (numbers, NUMBER), (spaces, WHITE)):
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = c
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("e", E), ("v", V), ("l", LL)):
        table[[ord(x) for x in chars]] = c
    table[END_POINT] = END
    return table


def _all_points() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(maxsize=1)
def tokenizers_classes() -> bytes:
    """Class table after the regular expressions of the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = _all_points()
    found = lambda p: "".join(x for x, _ in Split(Regex(p), "removed", invert=True).pre_tokenize_str(every))
    return pack_table(class_table(found(r"\p{L}"), found(r"\p{N}"), found(r"\s")))


@lru_cache(maxsize=1)
def tiktoken_classes() -> bytes:
    """Class table after the regular expressions of the tiktoken library."""
    import tiktoken

    every, ranks = _all_points(), {bytes([b]): b for b in range(256)}

    def found(pattern: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return probe.decode_bytes(probe.encode_ordinary(every)).decode()

    return pack_table(class_table(found(r"\p{L}"), found(r"\p{N}"), found(r"\s")))


@lru_cache(maxsize=4)
def unpacked(packed: bytes) -> np.ndarray:
    return unpack_table(packed)


def scan_states(classes: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """States before each character, and the characters' classes, as (place in chunk, chunk) arrays.

    Each chunk is run from all states at once; the chunks' state maps are composed by a parallel
    prefix scan (log2 of the number of chunks rounds); each chunk is then run once from its start state.
    """
    step, _ = machine()
    n_chunks = max(1, -(-len(classes) // chunk))
    grid = np.full(n_chunks * chunk, END, np.uint8)
    grid[: len(classes)] = classes
    grid = np.ascontiguousarray(grid.reshape(n_chunks, chunk).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], n_chunks, axis=1)
    for k, row in enumerate(grid):
        maps = step[maps * np.uint8(N_CLASSES) + row]
        if k % 16 == 15 and (maps == maps[0]).all():  # all states have met: the map is constant
            maps = maps[:1]
            break
    if len(maps) == 1:
        state = maps[0]
        for row in grid[k + 1 :]:
            state = step[state * np.uint8(N_CLASSES) + row]
        maps = np.repeat(state[None], N_STATES, axis=0)
    hop = 1
    while hop < n_chunks:  # maps[:, k] becomes the map of all chunks up to k
        maps[:, hop:] = np.take_along_axis(maps[:, hop:], maps[:, :-hop].astype(np.intp), axis=0)
        hop *= 2
    state = np.concatenate([np.array([S_START], np.uint8), maps[S_START, :-1]])
    states = np.empty_like(grid)
    for k, row in enumerate(grid):
        states[k] = state
        state = step[state * np.uint8(N_CLASSES) + row]
    return states, grid


def borders(classes: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens begin, ends of texts included, in order."""
    states, grid = scan_states(classes)
    bits = machine()[1][states * np.uint8(N_CLASSES) + grid].T.ravel()[: len(classes)]
    at = (bits & 1).astype(bool)
    at[:-1] |= (bits[1:] & 2).astype(bool)
    return np.flatnonzero(at)


def split_flat(texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts in order, and how many there are up to the end of each text."""
    end = chr(0)  # holds the place of END_POINT, which no string can contain
    joined = end.join(texts) + end
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = table[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes[ends] = END
    starts = borders(classes)
    cuts = np.searchsorted(starts, ends)
    places = starts.tolist()
    out, first = [], 0
    for last in cuts.tolist():  # places[last] is the end of the text
        here = places[first : last + 1]
        out += [joined[a:b] for a, b in zip(here, here[1:])]
        first = last + 1
    return out, cuts - np.arange(len(texts))


def split_texts(texts: list[str], table: np.ndarray) -> list[list[str]]:
    """The pre-tokens of each text."""
    pieces, ends = split_flat(texts, table)
    cuts = [0, *ends.tolist()]
    return [pieces[a:b] for a, b in zip(cuts, cuts[1:])]
