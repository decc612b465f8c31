"""Chinese numbers and relative dates, aliases of concepts, tokens for retrieval. Driver-side."""

from __future__ import annotations

import re
from datetime import date, timedelta

_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
_UNITS = {"十": 10, "百": 100, "千": 1000}
_LARGE = {"万": 10_000, "亿": 100_000_000}


def chinese_number(text: str) -> float | None:
    """三万五千 -> 35000, 1.2亿 -> 120000000, 十二 -> 12; None if it is no number."""
    m = re.fullmatch(r"(-?\d[\d,]*(?:\.\d+)?)\s*([万亿]?)", text.strip())
    if m:
        return float(m[1].replace(",", "")) * _LARGE.get(m[2], 1)
    if not text or any(c not in _DIGITS and c not in _UNITS and c not in _LARGE for c in text):
        return None
    total = section = digit = 0
    for c in text:
        if c in _DIGITS:
            digit = _DIGITS[c]
        elif c in _UNITS:
            section += (digit or 1) * _UNITS[c]
            digit = 0
        else:
            total = (total + section + digit) * _LARGE[c] if c == "亿" else total + (section + digit) * _LARGE[c]
            section = digit = 0
    return float(total + section + digit)


def date_range(words: str, today: date) -> tuple[date, date] | None:
    """First and last day of a relative or absolute period named in a question."""
    month = lambda y, m: (date(y, m, 1), date(y + m // 12, m % 12 + 1, 1) - timedelta(1))
    if m := re.search(r"(\d{4})\s*年\s*(\d{1,2})\s*月", words):
        return month(int(m[1]), int(m[2])) if 1 <= int(m[2]) <= 12 else None
    if m := re.search(r"(\d{4})\s*年?\s*第?([一二三四1-4])季度", words):
        q = "一二三四".find(m[2]) + 1 or int(m[2])
        return date(int(m[1]), 3 * q - 2, 1), month(int(m[1]), 3 * q)[1]
    if m := re.search(r"(\d{4})\s*年", words):
        return date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)
    if m := re.search(r"(?:最近|近|过去)\s*(\d+|[一二三四五六七八九十两]+)\s*(天|周|个月|月|年)", words):
        n = int(chinese_number(m[1]) or 0)
        return today - timedelta(n * {"天": 1, "周": 7, "个月": 30, "月": 30, "年": 365}[m[2]] - 1), today
    known = {
        "今天": (today, today), "昨天": (today - timedelta(1),) * 2, "前天": (today - timedelta(2),) * 2, "本周": (today - timedelta(today.weekday()), today), "上周": (today - timedelta(today.weekday() + 7), today - timedelta(today.weekday() + 1)),
        "本月": (today.replace(day=1), today), "上月": month(*((today.replace(day=1) - timedelta(1)).timetuple()[:2])), "上个月": month(*((today.replace(day=1) - timedelta(1)).timetuple()[:2])), "今年": (date(today.year, 1, 1), today), "去年": (date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)),
    }
    return next((v for k, v in known.items() if k in words), None)


def longest_aliases(text: str, aliases: dict[str, str]) -> list[tuple[str, str]]:
    """(alias, concept) found in a text, longest first; what a longer alias covers is not matched again."""
    out, taken = [], [False] * len(text)
    for alias in sorted(aliases, key=lambda a: (-len(a), a)):
        at = text.find(alias)
        while alias and at >= 0:
            if not any(taken[at : at + len(alias)]):
                taken[at : at + len(alias)] = [True] * len(alias)
                out.append((alias, aliases[alias]))
            at = text.find(alias, at + 1)
    return out


def question_kind(text: str) -> str:
    """judge, monitor, explain, trace, what_if or lookup, by its words."""
    for kind, words in (("what_if", ("如果", "假如", "假设", "若")), ("explain", ("为什么", "原因", "为何")), ("trace", ("追溯", "追踪", "来源", "上游", "下游")), ("monitor", ("哪些", "多少个违反", "监控", "预警")), ("judge", ("是否", "能不能", "可以吗", "合规", "需不需要"))):
        if any(w in text for w in words):
            return kind
    return "lookup"


def tokens(text: str) -> list[str]:
    """Identifiers and words in lower case; runs of CJK characters as bigrams."""
    out = []
    for run in re.findall(r"[A-Za-z0-9_]+|[一-鿿]+", text or ""):
        if "一" <= run[0] <= "鿿":
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        else:
            out.append(run.lower())
    return out


def bigram_similarity(a: str, b: str) -> float:
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or ({s} if s else set())
    x, y = grams(re.sub(r"\s", "", a or "")), grams(re.sub(r"\s", "", b or ""))
    return len(x & y) / len(x | y) if x | y else 0.0
