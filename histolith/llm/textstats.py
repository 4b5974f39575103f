"""Text statistics of many documents at a time, on arrays of code points.

The texts of an Arrow batch are laid end to end, each closed by a line end, and every statistic is a
count of characters, tokens, terms or lines of that one array, summed up by document. A character is
looked up once in a table of classes; no statistic scans the texts with a pattern of its own, which
as built-in SQL expressions cost about ten times the CPU seconds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

SPACE, NEWLINE, LOWER, UPPER, LETTER, MARK, DIGIT, SYMBOL = range(8)
CJK_RANGES = ((0x3040, 0x30FF), (0x4E00, 0x9FFF))
STOPS = ".!?。！？…"
CLOSERS = "\"'”’»)]"
APOSTROPHES = "’'"
COMMAS = ",;:、，"
BULLETS = "-*•·+–"
#: Letters that can be the core of a syllable in Latin script.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ"
#: Characters whose arrays are held at a time; one longer text is held whole.
CHUNK_CHARS = 1_000_000
TABLE = 0x10000

STATISTICS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "mean_line_words", "longest_word", "symbol_ratio", "digit_ratio", "upper_ratio", "letter_ratio", "cjk_ratio", "foreign_ratio",
    "vowel_ratio", "mixed_rate", "joint_rate", "repeat_rate", "consonant_rate", "class_entropy", "line_end_share", "line_end_chars", "bullet_share", "bullet_chars", "short_line_share",
    "short_line_chars", "brief_line_share", "tiny_line_share", "cell_line_share", "cell_line_chars", "distinct_line_share", "number_share", "common_share", "common_pair_share",
    "distinct_terms", "distinct_share", "stop_rate", "inner_stop_rate", "comma_rate",
)


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lo": LETTER, "Lm": LETTER, "Mn": MARK, "Mc": MARK, "Me": MARK, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE}
    chars = [chr(i) for i in range(TABLE)]
    cls = np.array([kinds.get(unicodedata.category(c), SYMBOL) for c in chars], np.uint8)
    cls[[ord(c) for c in "\t\v\f\r"]] = SPACE
    cls[ord("\n")] = NEWLINE
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    latin = np.array([cls[i] in (LOWER, UPPER) and i < 0x250 for i in range(TABLE)])
    vowel = np.zeros(TABLE, bool)
    vowel[[ord(c) for c in VOWELS + VOWELS.upper()]] = True
    out = {"cls": cls, "lower": lower, "vowel": vowel, "consonant": latin & ~vowel, "cjk": np.zeros(TABLE, bool)}
    for lo, hi in CJK_RANGES:
        out["cjk"][lo : hi + 1] = True
    for name, of in (("stop", STOPS), ("closer", CLOSERS), ("apostrophe", APOSTROPHES), ("comma", COMMAS), ("bullet", BULLETS)):
        out[name] = np.zeros(TABLE, bool)
        out[name][[ord(c) for c in of]] = True
    return out


def _segment_hash(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment of code points; depends on the characters and their places only."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    v = (points[np.repeat(start, length) + at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= at.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B8) + np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(32)
    return np.add.reduceat(v, np.cumsum(length) - length) * np.uint64(0xD6E8FEB86659FD93) + length.astype(np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words as the terms of a text have them."""
    lower = _tables()["lower"]
    arrays = [_points(w) for w in words if w]
    if not arrays:
        return np.zeros(0, np.uint64)
    points = np.concatenate(arrays)
    points = np.where(points < TABLE, lower[np.minimum(points, TABLE - 1)], points)
    end = np.cumsum([len(a) for a in arrays])
    return np.unique(_segment_hash(points, end - [len(a) for a in arrays], end))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes in each document."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


def statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """Every statistic of every text; ``common`` are ``word_hashes`` of the common words."""
    tab, n = _tables(), len(texts)
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    cp = _points("\n".join(texts) + "\n")
    sizes = np.array([len(t) + 1 for t in texts])
    first_of = np.cumsum(sizes) - sizes  # of each document
    low = np.minimum(cp, TABLE - 1).astype(np.int64)  # the last place of the table is no character
    cls = tab["cls"][low]
    cls[(cp >= 0x20000) & (cp < 0x40000)] = LETTER
    by_doc: Callable[[np.ndarray], np.ndarray] = lambda mask: np.add.reduceat(mask, first_of, dtype=np.int64).astype(float)
    before = lambda a: np.concatenate([[0], np.cumsum(a, dtype=np.int64)])

    solid = cls >= LOWER
    letter = (cls >= LOWER) & (cls <= LETTER)
    digit, symbol = cls == DIGIT, cls == SYMBOL
    counts = {c: by_doc(cls == c) for c in (LOWER, UPPER, LETTER, MARK, DIGIT, SYMBOL)}
    letters = counts[LOWER] + counts[UPPER] + counts[LETTER]
    chars = letters + counts[MARK] + counts[DIGIT] + counts[SYMBOL]
    out: dict[str, np.ndarray] = {"n_chars": (sizes - 1).astype(float)}

    # Tokens: runs without white space.
    start, end = _runs(solid)
    token_doc = np.searchsorted(first_of, start, side="right") - 1
    words = np.bincount(token_doc, minlength=n).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, token_doc, (end - start).astype(float))
    letters_before, digits_before = before(letter), before(digit)
    number = (letters_before[end] == letters_before[start]) & (digits_before[end] > digits_before[start])
    out |= {"n_words": words, "mean_word_length": _ratio(chars, words), "longest_word": longest, "number_share": _ratio(np.bincount(token_doc[number], minlength=n).astype(float), words)}

    # Classes of characters, and of their neighbours.
    out |= {"symbol_ratio": _ratio(counts[SYMBOL], chars), "digit_ratio": _ratio(counts[DIGIT], chars), "upper_ratio": _ratio(counts[UPPER], letters), "letter_ratio": _ratio(letters, chars)}
    cjk = tab["cjk"][low]
    vowels, consonant = by_doc(tab["vowel"][low]), tab["consonant"][low]
    out |= {"cjk_ratio": _ratio(by_doc(cjk), chars), "foreign_ratio": _ratio(by_doc((cp > 127) & solid), chars), "vowel_ratio": _ratio(vowels, vowels + by_doc(consonant))}
    a, b = cls[:-1], cls[1:]
    la, lb = letter[:-1], letter[1:]
    mixed = (la & digit[1:]) | (digit[:-1] & lb) | ((a == LOWER) & (b == UPPER))
    joint = (la & symbol[1:]) | (symbol[:-1] & lb)
    pad = lambda m: np.append(m, False)
    out |= {"mixed_rate": _ratio(by_doc(pad(mixed)), chars), "joint_rate": _ratio(by_doc(pad(joint)), chars)}
    same = np.append(False, (cp[1:] == cp[:-1])) & solid
    long_same = np.zeros(n)
    s, e = _runs(same)
    held = (e - s) >= 3  # four equal characters are three repetitions
    np.add.at(long_same, np.searchsorted(first_of, s[held], side="right") - 1, (e - s + 1)[held])
    hard = np.zeros(n)
    s, e = _runs(consonant)
    held = (e - s) >= 5
    np.add.at(hard, np.searchsorted(first_of, s[held], side="right") - 1, (e - s)[held])
    out |= {"repeat_rate": _ratio(long_same, chars), "consonant_rate": _ratio(hard, chars)}
    shares = [_ratio(c, chars) for c in counts.values()]
    out["class_entropy"] = -sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0) for p in shares)

    # Lines that hold anything, without the white space around them.
    newline = np.nonzero(cls == NEWLINE)[0]
    token_line = np.searchsorted(newline, start)
    head = np.nonzero(np.append(True, token_line[1:] != token_line[:-1]))[0] if len(start) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(start)) - 1 if len(head) else head
    first, last = start[head], end[tail] - 1
    line_doc, line_words, line_chars = token_doc[head], tail - head + 1, last - first + 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    all_chars = np.bincount(line_doc, weights=line_chars, minlength=n)
    places = np.arange(len(cp))
    core = np.maximum.accumulate(np.where(solid & ~tab["closer"][low], places, -1))[last]
    stop = tab["stop"][low]
    ends = (core >= first) & stop[core]
    inside = lambda mask: (lambda c: c[last + 1] - c[first])(before(mask))
    following = np.append(solid[1:], False)
    tight = lambda c: inside((cp == ord(c)) & following)
    blank = cp == ord(" ")
    gap = np.zeros(len(cp), bool)
    gap[2:] = blank[2:] & blank[1:-1] & blank[:-2]
    at = lambda i, c: np.append(cp[i:] == ord(c), np.zeros(i, bool))
    closing = at(0, "<") & at(1, "/") & at(2, "t") & (at(3, "d") | at(3, "h")) & at(4, ">")
    cells = (inside(cp == ord("\t")) >= 2) | (inside(cp == ord("|")) >= 2) | (tight(";") >= 3) | (tight(",") >= 3) | (inside(gap & following) >= 2) | (inside(closing) >= 2)
    facts = {"line_end": ends, "bullet": _bullets(cp, tab, first, end[head] - first, line_words), "short_line": (line_words <= 7) & ~ends, "cell_line": cells, "brief_line": line_words <= 7, "tiny_line": line_words <= 3}
    for name, fact in facts.items():
        out[f"{name}_share"] = _ratio(np.bincount(line_doc[fact], minlength=n).astype(float), lines)
        out[f"{name}_chars"] = _ratio(np.bincount(line_doc[fact], weights=line_chars[fact], minlength=n), all_chars)
    out |= {"n_lines": lines, "mean_line_words": _ratio(words, lines), "distinct_line_share": _ratio(_distinct(line_doc, _segment_hash(cp, first, last + 1), n), lines)}

    # Terms: runs of letters, marks and apostrophes, and each CJK character.
    of_term = letter | (cls == MARK) | tab["apostrophe"][low]
    opens = of_term.copy()
    opens[1:] &= ~of_term[:-1] | cjk[:-1]
    t0 = np.nonzero(opens)[0]
    closes = of_term.copy()
    closes[:-1] &= ~of_term[1:] | cjk[:-1]
    t1 = np.nonzero(closes)[0] + 1
    term_doc = np.searchsorted(first_of, t0, side="right") - 1
    lowered = np.where(cp < TABLE, tab["lower"][low], cp)
    hashes = _segment_hash(lowered, t0, t1)
    terms = np.bincount(term_doc, minlength=n).astype(float)
    place = np.searchsorted(common, hashes)
    known = common[np.minimum(place, len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    twice = known[1:] & known[:-1] & (term_doc[1:] == term_doc[:-1])
    distinct = _distinct(term_doc, hashes, n)
    after = np.append(cls[1:], NEWLINE)
    next_low = np.append(low[1:], ord("\n"))
    full = stop & ((after <= NEWLINE) | tab["closer"][next_low] | (next_low == ord("<")) | (next_low == ord("[")))
    earlier = np.append(False, letter[:-1] | digit[:-1])
    inner = stop & earlier & ((after == SPACE) | (cjk[np.maximum(places - 1, 0)] & np.append(cjk[1:], False)))
    inner_before = before(inner)
    inner_stops = np.bincount(line_doc, weights=inner_before[last] - inner_before[first], minlength=n)
    out |= {
        "common_share": _ratio(np.bincount(term_doc[known], minlength=n).astype(float), terms),
        "common_pair_share": _ratio(np.bincount(term_doc[1:][twice], minlength=n).astype(float), terms),
        "distinct_terms": distinct,
        "distinct_share": _ratio(distinct, terms),
        "stop_rate": _ratio(by_doc(full), terms),
        "inner_stop_rate": _ratio(inner_stops, lines),
        "comma_rate": _ratio(by_doc(tab["comma"][low]), terms),
    }
    empty = words == 0
    return {name: np.where(empty, 0.0, out[name]) for name in STATISTICS}


def _bullets(cp: np.ndarray, tab: dict[str, np.ndarray], first: np.ndarray, length: np.ndarray, line_words: np.ndarray) -> np.ndarray:
    """Lines that begin with a bullet, a box to tick, or a number or letter of a list, and go on after it."""
    c = [cp[np.minimum(first + i, len(cp) - 1)] for i in range(5)]
    is_ = lambda i, of: np.isin(c[i], [ord(x) for x in of])
    at = lambda arrays, i: np.choose(np.minimum(i, 4), arrays)
    sign = (length == 1) & tab["bullet"][np.minimum(c[0], TABLE - 1)]
    box = is_(0, "[") & (((length == 2) & is_(1, "]")) | ((length == 3) & is_(1, "xX") & is_(2, "]")))
    open_box = (length == 1) & is_(0, "[") & is_(1, " ") & is_(2, "]") & (line_words >= 3) & np.isin(c[3], [ord(" "), ord("\t")])
    bracket = is_(0, "(").astype(np.int64)
    digits = [(x >= ord("0")) & (x <= ord("9")) for x in c]
    ascii_letter = [((x | 32) >= ord("a")) & ((x | 32) <= ord("z")) for x in c]
    closed = [np.isin(x, [ord(y) for y in ".)]"]) for x in c]
    number = np.zeros(len(first), bool)
    for k in (1, 2, 3):
        is_number = np.ones(len(first), bool)
        for i in range(k):
            is_number &= at(digits, bracket + i)
        number |= is_number & at(closed, bracket + k) & (length == bracket + k + 1)
    single = at(ascii_letter, bracket) & at(closed, bracket + 1) & (at(c, bracket + 1) != ord("]")) & (length == bracket + 2)
    return ((sign | box | number | single) & (line_words >= 2)) | open_box


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS`` characters."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_CHARS:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
