"""The time window a question asks for, in UTC, read word by word."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from runloom.plans import lexicon as L

Window = tuple[datetime, datetime]
_MONTH = {name: i for i, names in enumerate(L.MONTHS, 1) for name in names}
_DAY = timedelta(days=1)


def words_of(text: str) -> list[str]:
    """Runs of digits, runs of letters a-z and single signs, in lower case."""
    return re.findall(r"[0-9]+|[a-z]+|[^\sa-z0-9]", text.lower())


def _calendar(year: int, month: int, day: int) -> datetime | None:
    """A date whose month or day may run over, as in 31 June; None outside the calendar."""
    over, month = divmod(month - 1, 12)
    try:
        return datetime(year + over, month + 1, 1) + timedelta(days=day - 1)
    except (ValueError, OverflowError):
        return None


def _is_number(word: str, least: int, most: int) -> bool:
    return word.isdecimal() and least <= len(word) <= most


def _numeric(words: list[str]) -> tuple[bool, datetime | None]:
    """Whether three joined numbers with a year of four digits are there, and their date; the year may come first or last."""
    for sizes in ((4, 2, 2), (2, 2, 4)):
        for at in range(len(words) - 4):
            three, signs = words[at : at + 5 : 2], words[at + 1 : at + 4 : 2]
            if not all(s in L.DATE_SIGNS for s in signs) or not all(_is_number(w, n if n == 4 else 1, n) for w, n in zip(three, sizes)):
                continue
            first, middle, last = map(int, three)
            if sizes[0] == 4:
                return True, _calendar(first, middle, last)
            # day before month, unless only the other way is possible
            day, month = (middle, first) if middle > 12 >= first else (first, middle)
            return True, _calendar(last, month, day) if 1 <= month <= 12 and 1 <= day <= 31 else None
    return False, None


def _spoken(words: list[str], now: datetime) -> datetime | None:
    """A month's name beside a day: the first word before a small number, or else the first behind one, has to be a month."""
    plain: list[str] = []
    for word in words:
        # endings of numbers, the stop of a short month, and "of" say nothing
        silent = plain and (word in L.ORDINALS if plain[-1].isdecimal() else word == ".") or word == "of"
        if not silent:
            plain.append(word)
    pairs = list(zip(plain, plain[1:]))
    before = next(((b, a) for a, b in pairs if a.isalpha() and _is_number(b, 1, 2)), None)
    behind = next(((a, b) for a, b in pairs if _is_number(a, 1, 2) and b.isalpha()), None)
    for pair in (before, behind):
        if pair and pair[1] in _MONTH:
            month, day = _MONTH[pair[1]], int(pair[0])
            found = _calendar(now.year, month, day)
            # a date without a year that lies ahead is last year's
            return _calendar(now.year - 1, month, day) if found and found - now > _DAY else found
    return None


def parse_date(words: list[str], now: datetime) -> datetime | None:
    """The date that the words name; numbers with a year come before names of months."""
    written, found = _numeric(words)
    return found if written else _spoken(words, now)


def _sentence(words: list[str]) -> list[str]:
    """The words up to the end of the sentence; a stop between numbers does not end it."""
    for at, word in enumerate(words):
        if word in "?!" or word == "." and not (words[at - 1 : at] and words[at - 1].isdecimal() and words[at + 1 : at + 2] and words[at + 1].isdecimal()):
            return words[:at]
    return words


def _behind(words: list[str], openers: tuple[str, ...]) -> list[str] | None:
    """The rest of the sentence behind the first opener that has one."""
    for at, word in enumerate(words):
        if word in openers and (rest := _sentence(words[at + 1 :])):
            return rest
    return None


def _counted(words: list[str], now: datetime) -> Window | None:
    for opener, number, unit in zip(words, words[1:], words[2:]):
        if opener in L.RECENT and number.isdecimal() and unit.removesuffix("s") in L.UNIT_HOURS:
            return now - timedelta(hours=int(number) * L.UNIT_HOURS[unit.removesuffix("s")]), now
    return None


def _named(words: list[str], now: datetime) -> Window | None:
    today = datetime(now.year, now.month, now.day)
    monday, month = today - today.weekday() * _DAY, today.replace(day=1)
    spans: dict[str, Callable[[], Window]] = {
        "last hour": lambda: (now - timedelta(hours=1), now),
        "today": lambda: (today, now),
        "yesterday": lambda: (today - _DAY, today),
        "this week": lambda: (monday, now),
        "last week": lambda: (monday - 7 * _DAY, monday),
        "this month": lambda: (month, now),
        "last month": lambda: ((month - _DAY).replace(day=1), month),
    }
    said = f" {' '.join(words)} "
    name = next((name for phrase, name in L.NAMED if f" {phrase} " in said), None)
    return spans[name]() if name else None


def _between(words: list[str], now: datetime) -> Window | None:
    rest = _behind(words, L.RANGE_OPENERS) or []
    at = next((i for i, w in enumerate(rest) if i and w in L.RANGE_JOINTS), None)
    if at is None:
        return None
    first, last = parse_date(rest[:at], now), parse_date(rest[at + 1 :], now)
    return (first, last + _DAY) if first and last else None


def _since(words: list[str], now: datetime) -> Window | None:
    first = parse_date(_behind(words, L.SINCE) or [], now)
    return (first, now) if first else None


def _on(words: list[str], now: datetime) -> Window | None:
    # behind "on" only its own sentence counts
    day = parse_date(_behind(words, L.ON) or words, now)
    return (day, day + _DAY) if day else None


def parse_window(question: str, now: datetime) -> Window | None:
    """[start, end) of the question's time expression, the first kind that it has, or None. ``now`` is UTC wall time."""
    words = words_of(question)
    try:
        return next((found for read in (_counted, _named, _between, _since, _on) if (found := read(words, now))), None)
    except OverflowError:
        return None
