"""Per-document text quality statistics, and whether most of a text is lists, tables or junk.

Texts are laid end to end as code points and all lines of a block are measured at once: counts of
character classes per line, words, their lengths and hashes. Three signals of layout are taken:

- vertical delimiter alignment: pipes and the edges of cells that stand in the column of one in the line
  before or behind, and commas, semicolons and tabs of which neighbouring lines have equally many;
- indentation periodicity: short lines whose indentation comes back within LAGS lines, and per text the
  greatest autocorrelation of the indentation over these lags;
- the greatest autocorrelation of the line lengths over the same lags.

Tables are aligned lines, lists are marked lines and periodic short ones, and junk is told by word, symbol
and digit ratios. Prefixes of the export format (comment marks, output marks, JSON quotes) are skipped
first. What decides on a text is a logistic model over the shares of its lists, tables and junk, the three
signals, and the ratios of symbols, punctuated lines, common words and the mean word length. It is fitted
on at most LABELLED labelled texts; its prior is the definition (the shares add up to one half), so that
few labels move it little and none leave it as it is. Lines are compared with neighbours of their own text
only, so blocks of documents are independent and nothing but labels is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that a task measures at once (one larger text is measured alone).
BLOCK = 2_000_000

PLAIN, LIST, TABLE, JUNK = 0, 1, 2, 3

# character classes
LETTER, DIGIT, SPACE, COMMA, TAB, PIPE, COLON, STOP, OPEN, QUOTE, SYMBOL, WIDE, ODD, NEWLINE = range(14)


def _classes() -> np.ndarray:
    table = np.full(0x3000, ODD, np.uint8)
    table[:128] = SYMBOL
    for text, kind in (("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER), ("0123456789", DIGIT), (" ", SPACE), (",", COMMA), ("\t", TAB), ("|", PIPE), (":;", COLON), (".!?", STOP), ("()[]{}<>", OPEN), ("'\"`", QUOTE), ("\n\r", NEWLINE)):
        table[[ord(c) for c in text]] = kind
    # letters of alphabets count as such; Latin-1 capitals outside words are what broken encodings leave
    for code in range(128, 0x3000):
        if chr(code).isalpha():
            table[code] = LETTER
    table[0xA0] = SPACE
    return table


CLASS = _classes()
#: Letters that broken encodings of Western text are full of.
BROKEN = np.array([ord(c) for c in "ÃÂâïÐ"], np.uint32)
#: Characters of a short line of text without blanks at most, and the punctuation that it has not.
WIDE_SHORT = 16
#: Periods, in lines, of indentation and line lengths that are looked for.
LAGS = 4
WIDE_STOPS = np.array([ord(c) for c in "，。！？；："], np.uint32)
#: Ranges of the letters and digits of scripts that are written without blanks.
WIDE_LETTERS = ((0x3005, 0x3007), (0x3040, 0xD7FF), (0xF900, 0xFAFF), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFFDC), (0x20000, 0x3FFFF))
STATISTICS = {
    "n_words": "long",
    "mean_word_length": "double",
    "symbol_ratio": "double",
    "punctuated_lines": "double",
    "common_words": "double",
    "delimiter_alignment": "double",
    "indent_periodicity": "double",
    "length_autocorrelation": "double",
    "list_share": "double",
    "table_share": "double",
    "junk_share": "double",
}


def _hashes(points: np.ndarray, starts: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Hash of each letter run, ASCII letter case ignored; ``points`` are the letters only, ``run`` their run."""
    lowered = points + np.where((points >= 65) & (points <= 90), 32, 0).astype(np.uint32)
    depth = np.arange(len(points)) - starts[run]
    power = np.cumprod(np.r_[1, np.full(63, 0x9E3779B97F4A7C15, np.uint64)].astype(np.uint64))
    return np.add.reduceat(lowered.astype(np.uint64) * power[np.minimum(depth, 63)], starts)


def word_hash(word: str) -> int:
    points = np.array([ord(c) for c in word], np.uint32)
    return int(_hashes(points, np.array([0]), np.zeros(len(points), int))[0])


#: Labelled texts that the model is fitted on at most: those with the smallest hashes.
LABELLED = 2000
#: The model's inputs, with the prior means of their weights and of the constant; PRECISION is that of all weights.
PRIOR = {"delimiter_alignment": 0.0, "indent_periodicity": 0.0, "length_autocorrelation": 0.0, "symbol_ratio": 0.0, "punctuated_lines": 0.0, "common_words": 0.0, "mean_word_length": 0.0, "list_share": 8.0, "table_share": 8.0, "junk_share": 8.0}
PRIOR_CONSTANT = -4.0
PRECISION = 0.1


def autocorrelation(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Per text the greatest autocorrelation of its lines' ``value`` over lags of 1 to LAGS lines; 0 if all are equal or there are fewer than 2 * LAGS."""
    count = np.bincount(doc, minlength=n)
    mean = np.divide(np.bincount(doc, value, minlength=n), count, out=np.zeros(n), where=count > 0)
    centred = value - mean[doc]
    spread = np.bincount(doc, centred**2, minlength=n)
    best = np.full(n, -1.0)
    for lag in range(1, LAGS + 1):
        same = doc[lag:] == doc[:-lag]
        product = np.bincount(doc[lag:][same], (centred[lag:] * centred[:-lag])[same], minlength=n)
        best = np.maximum(best, np.divide(product, spread, out=np.zeros(n), where=spread > 1e-9))
    return np.where((count >= 2 * LAGS) & (spread > 1e-9), best, 0.0)


class Lines:
    """The measured lines of a block of texts."""

    def __init__(self, texts: list[str], wide_words: list[str] | None = None):
        # a line end is put behind every text, so no line spans two texts
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(points < 0x3000, CLASS[np.minimum(points, 0x2FFF)], np.where(points == 0xFFFD, ODD, WIDE)).astype(np.uint8)
        self.points, self.kind = points, kind
        ends = np.flatnonzero(points == 10)
        starts = np.r_[0, ends[:-1] + 1]
        sizes = np.array([len(t) for t in texts]) + 1
        self.doc = np.searchsorted(np.cumsum(sizes), starts, "right")
        self.start, self.end = starts, ends
        self.length = ends - starts
        blank = (kind == SPACE) | (kind == TAB) | (kind == NEWLINE)
        self.solid = np.flatnonzero(~blank)
        self._trim()
        self._count(blank)
        self._segment(wide_words or [])
        self._words(blank)

    def _next(self, at: np.ndarray) -> np.ndarray:
        """The first visible character at or behind a place, or the line's end."""
        if not len(self.solid):
            return self.end.copy()
        i = np.searchsorted(self.solid, at)
        return np.minimum(self.solid[np.minimum(i, len(self.solid) - 1)] * (i < len(self.solid)) + self.end * (i >= len(self.solid)), self.end)

    def _trim(self) -> None:
        """Places of the content of each line, without blanks, output and comment marks, and JSON quotes."""
        points = np.r_[self.points, np.zeros(4, np.uint32)]
        first = self._next(self.start)
        self.outer = first
        mark = points[first] == ord("#")
        output = mark & (points[first + 1] == ord(">"))
        comment = mark & (points[first + 1] == ord(" "))
        first = self._next(np.minimum(first + np.where(output, 2, np.where(comment, 1, 0)), self.end))
        self.commented = comment
        quoted = points[first] == ord('"')
        if len(self.solid):
            last = self.solid[np.maximum(np.searchsorted(self.solid, self.end) - 1, 0)] + 1
        else:
            last = self.start.copy()
        last = np.clip(last, first, self.end)
        comma = quoted & (last - first > 2) & (points[np.maximum(last - 1, 0)] == ord(",")) & (points[np.maximum(last - 2, 0)] == ord('"'))
        last = last - comma
        closed = quoted & (last - first > 1) & (points[np.maximum(last - 1, 0)] == ord('"'))
        self.quoted = closed
        self.last = last - closed
        self.first = np.minimum(self._next(np.minimum(first + closed, self.end)), self.last)
        self.first = np.maximum(self.first, self.start)
        self.last = np.maximum(self.last, self.first)
        self.indent = self.first - self.start
        self.size = self.last - self.first
        self.head = [np.where(self.first + i < self.last, points[self.first + i], 0) for i in range(4)]
        self.tail = np.where(self.size > 0, points[np.maximum(self.last - 1, 0)], 0)

    def _sum(self, mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[self.last] - total[self.first]

    def _count(self, blank: np.ndarray) -> None:
        kind, points = self.kind, self.points
        self.of = {k: self._sum(kind == k) for k in (LETTER, DIGIT, COMMA, TAB, PIPE, COLON, OPEN, SYMBOL, STOP, WIDE, ODD)}
        self.broken = self._sum(np.isin(points, BROKEN) & (points > 127)) if (points > 127).any() else np.zeros(len(self.start), int)
        self.equals = self._sum(points == ord("="))
        self.semicolons = self._sum(points == ord(";"))
        # delimiters of values, which no blank follows as it does in sentences and code
        self.tight = {c: self._sum((points == ord(c)) & ~np.r_[blank[1:], True]) for c in ",;"}
        self.stops = self._sum(np.isin(points, WIDE_STOPS))
        self.percent = self._sum(points == ord("%"))
        self.escaped_tabs = self._sum((points == ord("\\")) & (np.r_[points[1:], 0] == ord("t")))
        begins = ~blank & np.r_[True, blank[:-1]]
        self.words = np.maximum(self._sum(begins), (self.size > 0).astype(int))
        gap = blank & np.r_[blank[1:], False] & ~np.r_[False, blank[:-1]]
        self.gaps = self._sum(gap & (points != 10))
        self.pipes = points == ord("|")
        self.columns = np.maximum.reduce([self._columns(edge) for edge in (gap & (points != 10), begins & np.r_[False, False, (blank[1:] & blank[:-1])[:-1]], self.pipes)])

    def _columns(self, edge: np.ndarray) -> np.ndarray:
        """Vertical alignment: per line the share of its edges (2 at least) that stand in the column of an edge of the line before or behind."""
        at = np.flatnonzero(edge)
        line = np.searchsorted(self.start, at, "right") - 1
        # the first cell is where the indentation puts it; a pipe before it is an edge
        inside = ((at > self.first[line]) | self.pipes[at]) & (at >= self.first[line]) & (at < self.last[line])
        at, line = at[inside], line[inside]
        width = int(self.length.max(initial=0)) + 1
        column = at - self.start[line]
        place = line * width + column
        near = np.zeros(len(at), bool)
        for step in (-1, 1):
            other = np.clip(line + step, 0, len(self.start) - 1)
            found = np.minimum(np.searchsorted(place, other * width + column), len(place) - 1)
            near |= (place[found] == other * width + column) & (other != line) & (self.doc[other] == self.doc[line])
        edges = np.bincount(line, minlength=len(self.start))
        return np.divide(np.bincount(line, near, minlength=len(self.start)), edges, out=np.zeros(len(edges)), where=edges >= 2)

    def _segment(self, words: list[str]) -> None:
        """Words of text without blanks: the longest known word at each place, and the stretches between known words.

        ``wide_start`` are the words' places, ``wide_word`` their index in ``words`` (-1: not known);
        ``break_at`` also holds where other characters follow such text.
        """
        points = self.points
        self.wide_start = self.break_at = self.wide_word = np.zeros(0, np.int64)
        letter = np.zeros(len(points), bool)
        far = np.flatnonzero(points >= 0x3000)
        for low, high in WIDE_LETTERS:
            letter[far[(points[far] >= low) & (points[far] <= high)]] = True
        if not len(far):
            return
        at = np.flatnonzero(letter)
        best, size = np.full(len(at), -1), np.zeros(len(at), np.int64)
        padded = np.r_[points, np.zeros(max(map(len, words), default=0), np.uint32)]
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):  # longer ones overwrite
            hit = np.logical_and.reduce([padded[at + j] == ord(c) for j, c in enumerate(words[i])])
            best[hit], size[hit] = i, len(words[i])
        known, free = [], 0
        found = np.flatnonzero(best >= 0)
        for where, place, length in zip(found.tolist(), at[found].tolist(), size[found].tolist()):
            if place >= free:
                known.append(where)
                free = place + length
        known = np.array(known, np.int64)
        name = np.full(len(points) + 1, -1)
        name[at[known]] = best[known]
        inside, fresh = np.zeros(len(points) + 1, np.int64), np.zeros(len(points) + 1, bool)
        np.add.at(inside, at[known], 1)
        np.add.at(inside, at[known] + size[known], -1)
        fresh[at[known]] = fresh[at[known] + size[known]] = True
        inside, fresh = np.cumsum(inside[:-1]) > 0, fresh[:-1]
        fresh |= ~np.r_[False, letter[:-1]] & ~inside
        self.wide_start = np.flatnonzero(fresh & letter)
        self.wide_word = name[self.wide_start]
        # such letters and their punctuation end a word
        ends = letter | ((points >= 0x3000) & (points <= 0x303F)) | ((points >= 0xFF00) & (points <= 0xFFEF))
        other = ((self.kind == LETTER) | (self.kind == DIGIT)) & np.r_[False, ends[:-1]]
        self.break_at = np.flatnonzero((fresh & letter) | other)

    def _words(self, blank: np.ndarray) -> None:
        """Longest unbroken word per line; letter runs with their hashes and lines."""
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        line = np.searchsorted(self.start, begin, "right") - 1
        self.longest = np.zeros(len(self.start), np.int64)
        np.maximum.at(self.longest, line, stop - np.maximum(begin, self.first[line]))
        if len(self.break_at):  # text without blanks has more words than unbroken stretches
            begin = np.union1d(begin, self.break_at)
            stop = np.minimum(stop[np.searchsorted(stop, begin, "right")], np.r_[begin[1:], len(self.points)])
            line = np.searchsorted(self.start, begin, "right") - 1
        self.token_doc, self.token_size = self.doc[line], stop - begin
        letter = self.kind == LETTER
        at = np.flatnonzero(letter)
        if not len(at):
            self.run_line = self.run_hash = np.zeros(0, np.int64)
            self.repeats = np.zeros(len(self.start), np.int64)
            return
        fresh = np.r_[True, np.diff(at) > 1]
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        self.run_hash = _hashes(self.points[at], starts, run)
        self.run_line = np.searchsorted(self.start, at[starts], "right") - 1
        same = np.r_[False, (self.run_hash[1:] == self.run_hash[:-1]) & (self.run_line[1:] == self.run_line[:-1])]
        self.repeats = np.bincount(self.run_line[same], minlength=len(self.start))

    def aligned(self, count: np.ndarray) -> np.ndarray:
        """Lines whose ``count`` (at least 2) agrees with the line before or behind in the same text."""
        near = (count[1:] == count[:-1]) & (count[1:] >= 2) & (self.doc[1:] == self.doc[:-1])
        return np.r_[False, near] | np.r_[near, False]

    def labels(self) -> np.ndarray:
        """PLAIN, LIST, TABLE or JUNK for each line."""
        n = np.maximum(self.size, 1)
        of, head = self.of, self.head
        letters, digits, commas = of[LETTER], of[DIGIT], of[COMMA]
        tabs = of[TAB] + self.escaped_tabs
        is_ = lambda h, text: np.isin(h, [ord(c) for c in text])
        some = self.size > 0
        wide = of[WIDE] * 3 > n
        digit_head = (head[0] >= 48) & (head[0] <= 57)

        # text in the cells: as many delimiters on every line of a run, no blank behind any, no brackets of code
        even = np.zeros(len(n), bool)
        for count, tight in ((commas, self.tight[","]), (self.semicolons, self.tight[";"])):
            even |= self._even(count, some & (count >= 2) & (tight >= count - is_(self.tail, ",;")) & (of[OPEN] == 0) & (self.equals == 0), 3)

        # junk
        unbroken = (self.longest >= 50) & ~wide
        hexadecimal = (self.words >= 8) & (n <= self.words * 3.6) & (digits * 4 > n) & (commas == 0) & (of[STOP] == 0) & (letters * 2 < n)
        log = (of[COLON] >= 2) & (digits * 6 > n) & (is_(head[0], "[") | digit_head) & (commas < 3) & (self.words >= 3) & ~even
        progress = (of[PIPE] >= 2) & (self.percent > 0) & (of[COLON] > 0) & (head[0] != ord("|"))
        marks = of[SYMBOL] + of[STOP] + of[PIPE] + of[COLON] + commas
        symbols = (self.size >= 8) & (marks * 10 > n * 7) & ((letters + digits) * 5 < n) & ~((head[0] == ord("|")) & (of[PIPE] >= 3))
        garbled = ((of[ODD] + self.broken) * 10 > n * 3) & (self.size >= 2) & ~wide & ~is_(head[0], "•–·")
        repeated = (self.words >= 4) & (self.repeats * 2 >= self.words)
        junk = some & (unbroken | hexadecimal | log | progress | symbols | garbled | repeated)

        # tables: a delimiter whose number agrees with a neighbour
        dense = (commas >= 2) & (self.words <= commas + 2) & (of[OPEN] - 2 * is_(head[0], "[") <= 2) & (self.equals == 0)
        csv = (commas >= 1) & (self.aligned(commas) | (digits * 3 > n)) & ((self.words <= 1) | (digits * 3 > n)) & (self.equals == 0)
        array = (commas >= 1) & (digits * 3 > n) & dense
        piped = (head[0] == ord("|")) & (of[PIPE] >= 2)
        markup = (head[0] == ord("<")) & ((head[1] == ord("t")) | ((head[1] == ord("/")) & (head[2] == ord("t"))))
        spaced = (self.gaps >= 2) & (self.columns * 2 >= 1) & (self.equals == 0)
        numbers = (self.words >= 2) & (digits * 2 > n) & self.aligned(self.words) & (self.equals == 0)
        table = some & ~junk & (csv | even | array | (tabs >= 1) & (self.equals == 0) & (of[OPEN] == 0) | piped | markup | spaced | numbers)

        # lists: markers, or runs of short lines of one indentation without the end of a sentence
        spaced_mark = (head[1] == 32) | (head[1] == 9)
        bullet = is_(head[0], "-*•+–·") & spaced_mark
        two = digit_head & is_(head[1], ".)") & (head[2] == 32)
        three = digit_head & (head[1] >= 48) & (head[1] <= 57) & is_(head[2], ".)")
        four = digit_head & (head[1] >= 48) & (head[1] <= 57) & (head[2] >= 48) & (head[2] <= 57) & is_(head[3], ".)") & (self.words >= 2)
        # numbers before text without blanks need none behind them
        after = np.where(is_(head[1], ".)、．）"), head[2], np.where((head[1] >= 48) & (head[1] <= 57) & is_(head[2], ".)、．）"), head[3], 0))
        unspaced = digit_head & (after >= 0x3000)
        # code has operators; a minus or star before a word at the margin has not
        marked = (bullet | two | three | four | unspaced) & (self.equals == 0) & (letters + of[WIDE] > 0)
        short = (self.words <= 5) & (letters + of[WIDE] > 0) & ((letters + of[WIDE]) * 10 > n * 7) & ~is_(self.tail, ".!?,;{[(") & (of[OPEN] == 0) & (self.equals == 0) & ~is_(head[0], "#`%!<@")
        # a line of text without blanks is short by its length, and has no punctuation of a sentence
        short &= ~wide | ((self.size <= WIDE_SHORT) & (self.stops == 0))
        run = self._in_run(short & some & ~junk & ~table, 4)
        listed = some & ~junk & ~table & (marked | run)

        label = np.zeros(len(n), np.int8)
        label[listed], label[table], label[junk] = LIST, TABLE, JUNK
        return self._closed(label)

    def _in_run(self, mask: np.ndarray, least: int) -> np.ndarray:
        """Members of runs of at least ``least`` lines of one text whose indentation comes back with a period of at most LAGS lines."""
        fresh = np.r_[True, ~(mask[1:] & mask[:-1] & (self.doc[1:] == self.doc[:-1]))]
        run = np.cumsum(fresh) - 1
        again = np.zeros(len(mask), bool)
        for lag in range(1, LAGS + 1):
            same = (run[lag:] == run[:-lag]) & (self.indent[lag:] == self.indent[:-lag])
            again[lag:] |= same
            again[:-lag] |= same
        size = np.bincount(run, mask & again, minlength=run[-1] + 1 if len(run) else 0)
        return mask & again & (size[run] >= least)

    def _even(self, count: np.ndarray, mask: np.ndarray, least: int) -> np.ndarray:
        """Members of runs of at least ``least`` lines of one text with the same ``count``."""
        fresh = np.r_[True, ~(mask[1:] & mask[:-1] & (self.doc[1:] == self.doc[:-1]) & (count[1:] == count[:-1]))]
        run = np.cumsum(fresh) - 1
        return mask & (np.bincount(run)[run] >= least)

    def _closed(self, label: np.ndarray) -> np.ndarray:
        """A short plain line between two junk lines, or behind one in the same indentation, belongs to them."""
        before, after = np.r_[0, label[:-1]], np.r_[label[1:], 0]
        same_before = np.r_[False, self.doc[1:] == self.doc[:-1]]
        same_after = np.r_[self.doc[1:] == self.doc[:-1], False]
        plain = (label == PLAIN) & (self.size > 0)
        between = plain & same_before & same_after & (before == JUNK) & (after == JUNK)
        # the last, shorter line of encoded data: one unbroken word under a longer one
        tail = plain & same_before & (before == JUNK) & (self.words == 1) & (self.size >= 4) & (np.r_[0, self.longest[:-1]] >= 50) & (self.of[OPEN] == 0)
        label[between | tail] = JUNK
        return label


def measure(texts: list[str], common: dict[str, np.ndarray], wide: dict[str, list[str]] | None = None) -> dict[str, np.ndarray]:
    """STATISTICS of each text; ``common`` holds the word hashes of each language, ``wide`` the words written without blanks."""
    wide = wide or {}
    wide_words = sorted({w for known in wide.values() for w in known})
    lines = Lines(texts, wide_words)
    label, n = lines.labels(), len(texts)
    chars = np.array([len(t) for t in texts], float)
    by_doc = lambda weight, mask=None: np.bincount(lines.doc if mask is None else lines.doc[mask], weight if mask is None else weight[mask], minlength=n)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    filled = (lines.size > 0).astype(float)
    out: dict[str, np.ndarray] = {}
    words = np.bincount(lines.token_doc, minlength=n)
    out["n_words"] = words
    out["mean_word_length"] = ratio(np.bincount(lines.token_doc, lines.token_size, minlength=n), words)
    of = lines.of
    out["symbol_ratio"] = ratio(by_doc((of[SYMBOL] + of[OPEN] + of[PIPE] + of[ODD]).astype(float)), chars)
    out["punctuated_lines"] = ratio(by_doc(np.isin(lines.tail, [ord(c) for c in ".!?:;。！？"]).astype(float) * filled), by_doc(filled))
    run_doc = lines.doc[lines.run_line] if len(lines.run_line) else np.zeros(0, int)
    wide_doc = lines.doc[np.searchsorted(lines.start, lines.wide_start, "right") - 1]
    runs = np.bincount(run_doc, minlength=n) + np.bincount(wide_doc, minlength=n)
    hits = []
    for lang in dict.fromkeys([*common, *wide]):
        is_known = np.isin(lines.run_hash, common.get(lang, ()))
        is_wide = np.isin(lines.wide_word, [i for i, w in enumerate(wide_words) if w in wide.get(lang, ())])
        hits.append(np.bincount(run_doc[is_known], minlength=n) + np.bincount(wide_doc[is_wide], minlength=n))
    out["common_words"] = ratio(np.max(hits, axis=0).astype(float), runs) if hits else np.zeros(n)
    delimiters = of[COMMA] + lines.semicolons + of[TAB] + of[PIPE]
    vertical = (lines.columns >= 0.5) | lines.aligned(delimiters)
    weight = (lines.length + 1).astype(float)
    out["delimiter_alignment"] = np.minimum(1.0, ratio(by_doc(weight * vertical), chars))
    # blank lines part paragraphs and cells, and have no place in the rhythm of a text
    full = lines.size > 0
    out["indent_periodicity"] = autocorrelation(lines.doc[full], lines.indent[full].astype(float), n)
    out["length_autocorrelation"] = autocorrelation(lines.doc[full], np.log1p(lines.size[full]), n)
    for name, kind in (("list_share", LIST), ("table_share", TABLE), ("junk_share", JUNK)):
        out[name] = np.minimum(1.0, ratio(by_doc(weight, label == kind), chars))
    return out


def fit(statistics: pd.DataFrame, other: np.ndarray) -> np.ndarray:
    """Weights of PRIOR's inputs and the constant that are most probable given texts of which ``other`` are not prose (Newton's method)."""
    x = np.column_stack([np.log1p(statistics[c]) if c == "mean_word_length" else statistics[c] for c in PRIOR] + [np.ones(len(statistics))]).astype(float)
    prior = np.array([*PRIOR.values(), PRIOR_CONSTANT])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).sum() - other @ (x @ w) + PRECISION / 2 * ((w - prior) ** 2).sum())

    w = prior
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), x.T @ (p - other) + PRECISION * (w - prior))
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def probability(weights: np.ndarray) -> Column:
    """That most of a text is lists, tables or junk, from its statistics."""
    z = F.lit(float(weights[-1]))
    for name, weight in zip(PRIOR, weights):
        z = z + F.lit(float(weight)) * (F.log1p(name) if name == "mean_word_length" else F.col(name))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def labelled(statistics: DataFrame, item: str, labels: DataFrame, label: str, prose: str, most: int | None = None) -> DataFrame:
    """``statistics`` of the texts whose labels agree, with ``other`` (the label is not ``prose``) and ``place`` (a hash to choose by).

    With ``most``, of the so many with the smallest hashes only; those are chosen first and broadcast.
    """
    agreed = labels.where(F.col(item).isNotNull() & F.col(label).isNotNull()).groupBy(item).agg(F.min(label).alias("least"), F.max(label).alias("most")).where("least = most")
    chosen = agreed.select(item, (F.col("least") != prose).alias("other"), F.xxhash64(item, F.lit(11)).alias("place"))
    if most is not None:
        chosen = F.broadcast(chosen.orderBy("place", item).limit(most))
    return statistics.join(chosen, item)


def fitted(statistics: DataFrame, item: str, labels: DataFrame, label: str = "label", prose: str = "prose", most: int = LABELLED) -> np.ndarray:
    """The model's weights from at most ``most`` labelled texts; those of the prior if there are none."""
    rows = labelled(statistics, item, labels, label, prose, most).orderBy("place", item).toPandas()
    return fit(rows, rows["other"].to_numpy().astype(float))


def text_statistics(df: DataFrame, item: str, text: str, common: dict[str, list[str]]) -> DataFrame:
    """``item`` and the STATISTICS of its whole text. ``common``: frequent words by language, a fixed small list.

    Null and empty texts have 0 everywhere. ``common_words`` is the highest share of words, being letter
    runs, among the words of one language. Text without blanks (Chinese, Japanese) is cut into words at
    the longest common words; a stretch between two of them is taken as one word, in the counts and
    lengths of words too. Shares of lists, tables and junk are shares of the text's characters.
    Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
    """
    is_wide = lambda w: any(low <= ord(c) <= high for c in w for low, high in WIDE_LETTERS)
    hashes = {lang: np.array(sorted({word_hash(w.lower()) for w in words if not is_wide(w)}), np.uint64) for lang, words in common.items()}
    wide = {lang: sorted({w for w in words if is_wide(w)}) for lang, words in common.items()}
    schema = T.StructType([T.StructField("item", df.schema[item].dataType)] + [T.StructField(k, T.LongType() if v == "long" else T.DoubleType()) for k, v in STATISTICS.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [x or "" for x in frame["text"]]
            block = np.cumsum([len(t) for t in texts]) // BLOCK if texts else np.zeros(0, int)
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    yield pd.DataFrame({"item": frame["item"].iloc[part].to_numpy(), **measure([texts[i] for i in part], hashes, wide)})

    return df.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("item", item)
