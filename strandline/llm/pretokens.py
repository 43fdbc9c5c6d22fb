"""Pre-tokenisation of byte-level BPE as a finite-state transducer over codepoint classes, run by scans in numpy.

The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` is compiled
into a deterministic transducer: its input symbols are codepoint classes (with at most three codepoints of lookahead
folded into the class), its states say what the current piece is, and a transition emits 1 when it begins a new piece.
The texts of a batch are one array of symbols, cut into chunks. For each chunk the map from entry state to exit
state is computed for all states at once; the maps compose associatively, so a prefix scan gives every chunk's entry
state, and a second pass over the chunks reads off the emissions.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import regex

# symbols
LETTER, NUMBER, PUNCT, SPACE_LAST, WHITE_LAST, WHITE, APOS1, APOS2, BREAK = range(9)
# states: at a forced start; in letters, numbers, punctuation; in white space whose end is not reached; after a space
# that joins what follows; one or two codepoints of a contraction still to come
S_START, S_LETTER, S_NUMBER, S_PUNCT, S_WHITE, S_SPACE, S_ONE, S_TWO = range(8)
N_SYMBOLS, N_STATES = 9, 8
#: Chunks of so many codepoints.
CHUNK = 256
#: Suffixes of contractions, by length. Fixed values of the public pattern.
SUFFIX1, SUFFIX2 = "stmd", ("re", "ve", "ll")


@functools.cache
def compiled() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by symbol * N_STATES + state."""
    nxt = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    emit = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    for state in range(N_STATES):
        for symbol in range(N_SYMBOLS):
            if symbol == BREAK:
                to, new = S_START, 1
            elif state == S_TWO:
                to, new = S_ONE, 0
            elif state == S_ONE:
                to, new = S_START, 0
            elif symbol in (LETTER, NUMBER):
                same = S_LETTER if symbol == LETTER else S_NUMBER
                to, new = same, int(state not in (same, S_SPACE))
            elif symbol in (PUNCT, APOS1, APOS2):
                joins = state in (S_PUNCT, S_SPACE)
                to = S_PUNCT if joins or symbol == PUNCT else S_ONE if symbol == APOS1 else S_TWO
                new = int(not joins)
            elif symbol == WHITE:
                to, new = S_WHITE, int(state != S_WHITE)
            else:  # the last white space before something else stands alone; a space joins what follows
                to, new = S_SPACE if symbol == SPACE_LAST else S_START, 1
            nxt[symbol, state], emit[symbol, state] = to, new
    return nxt.ravel(), emit.ravel()


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, PUNCT or WHITE of every codepoint, by the properties the public pattern names."""
    out = np.full(sys.maxunicode + 1, PUNCT, np.uint8)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            run = np.arange(a, b + 1)
            out[run[(run < 0xD800) | (run > 0xDFFF)]] = symbol
    return out


def symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The transducer's input for codepoints whose texts end at ``ends``; each text is followed by one separator (0)."""
    sym = classes()[cp]
    sym[ends] = BREAK
    nx = np.empty_like(sym)
    nx[:-1], nx[-1] = sym[1:], BREAK
    last = (sym == WHITE) & (nx != WHITE) & (nx != BREAK)
    sym_out = np.where(last, np.where(cp == 32, SPACE_LAST, WHITE_LAST), sym).astype(np.uint8)
    at = np.flatnonzero((cp == 39) & (sym == PUNCT))
    if len(at):
        n = len(cp)
        c1, c2 = cp[np.minimum(at + 1, n - 1)], cp[np.minimum(at + 2, n - 1)]
        one = np.isin(c1, [ord(c) for c in SUFFIX1])
        two = np.zeros(len(at), bool)
        for s in SUFFIX2:
            two |= (c1 == ord(s[0])) & (c2 == ord(s[1]))
        sym_out[at[one]], sym_out[at[two]] = APOS1, APOS2
    return sym_out


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Booleans: a new piece begins here. Chunk state maps, an exclusive prefix scan over them, then the emissions."""
    nxt, emit = compiled()
    n = len(sym)
    if n == 0:
        return np.zeros(0, bool)
    k = -(-n // CHUNK)
    padded = np.full(k * CHUNK, BREAK, np.uint8)
    padded[:n] = sym
    cols = np.ascontiguousarray(padded.reshape(k, CHUNK).T)
    base = cols.astype(np.uint16) * N_STATES
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8)[:, None], (N_STATES, k))
    for j in range(CHUNK):
        maps = nxt[base[j] + maps]
    # inclusive scan by doubling: composed[:, i] = maps up to chunk i; composition is associative
    composed, step = np.ascontiguousarray(maps.T), 1
    while step < k:
        upd = composed.copy()
        upd[step:] = np.take_along_axis(composed[step:], composed[:-step].astype(np.intp), axis=1)
        composed, step = upd, step * 2
    state = np.empty(k, np.uint8)
    state[0], state[1:] = S_START, composed[:-1, S_START]
    out = np.empty((CHUNK, k), np.uint8)
    for j in range(CHUNK):
        at = base[j] + state
        out[j] = emit[at]
        state = nxt[at]
    return out.T.reshape(-1)[:n].astype(bool)


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, starts, ends, pieces of each text, UTF-8 length of each text) of a batch of texts.

    Pieces never cross texts. An empty text has none.
    """
    joined = "\0".join(texts) + "\0"
    data = joined.encode("utf-8")
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text_ends = np.cumsum(lengths + 1) - 1
    width = np.ones(len(cp), np.int8)
    for least in (0x80, 0x800, 0x10000):
        width += cp >= least
    at = np.cumsum(width, dtype=np.int64) - width
    begins = np.flatnonzero(boundaries(symbols(cp, text_ends)))
    stops = np.empty_like(begins)
    stops[:-1], stops[-1:] = begins[1:], len(cp)
    real = np.ones(len(cp), bool)
    real[text_ends] = False
    real = real[begins]
    starts = at[begins[real]]
    ends = np.append(at, len(data))[stops[real]]
    owner_ends = np.searchsorted(begins[real], text_ends)
    counts = np.diff(np.concatenate([[0], owner_ends]))
    byte_ends = at[text_ends]
    n_bytes = np.diff(np.concatenate([[-1], byte_ends])) - 1
    return data, starts, ends, counts, n_bytes
