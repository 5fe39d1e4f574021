"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds short anchors: at-signs, digits,
plus signs, ``scheme://`` and identifier cues ("iban", "account", street
suffixes...).  From each anchor a small deterministic parser expands to both
sides, checks the candidate and fixes its bounds.  Whole texts are scanned;
work per anchor is linear in the span that it expands to.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from phenogrid.llm.common import small_batches

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\r\n\"'<>|`{}[]\\^")

KINDS = ("email", "ip", "card", "phone", "url", "email_obfuscated", "account", "address")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "routing", "sort code", "konto", "cuenta", "compte")
STREET_SUFFIXES = (" street", " avenue", " road", " boulevard", " lane", " drive")
AT_WORDS = (" at ", " (at) ", " [at] ")
DOT_WORDS = (" dot ", " (dot) ", " [dot] ")


def build_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    groups = (("digit", sorted(DIGITS)), ("at", ("@",)), ("plus", ("+",)), ("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("street", STREET_SUFFIXES), ("atword", AT_WORDS))
    for kind, words in groups:
        for word in words:
            auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _run(text: str, i: int, chars: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def _email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expands an at-sign to an address; nothing starts before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while last < len(text) and text[last] == ".":
        nxt = _run(text, last + 1, LABEL)
        if nxt == last + 1:
            break
        last = nxt
    return (start, last) if last > end else None


def _ip_at(text: str, i: int) -> tuple[int, bool] | None:
    """End of four dotted numbers that start at ``i``, and whether each is at most 255."""
    good = True
    for part in range(4):
        if part:
            if i >= len(text) or text[i] != ".":
                return None
            i += 1
        end = _run(text, i, DIGITS)
        if end == i:
            return None
        number = text[i:end].lstrip("0")
        good = good and (len(number) < 3 or len(number) == 3 and int(number) <= 255)
        i = end
    return i, good


def _card_end(text: str, i: int) -> int:
    """End of the chain of digits from ``i``, with at most one blank or hyphen between two."""
    n, i = len(text), i + 1
    while i < n:
        if text[i] in DIGITS:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in DIGITS:
            i += 2
        else:
            break
    return i


def _phone_at(text: str, plus: int) -> int | None:
    """End of the longest number after a plus sign."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in DIGITS else None


def _iban_ok(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _account_after(text: str, i: int) -> tuple[int, int] | None:
    """An identifier within a few characters of a cue that ends at ``i``."""
    j = i
    for word in ("number", "no.", "nr.", "no", "#"):
        k = _run(text, j, frozenset(" :=#"))
        if text[k : k + len(word)].lower() == word:
            j = k + len(word)
            break
    start = _run(text, j, frozenset(" :=#"))
    if start - j > 4 or start == i:
        return None
    end = start
    while end < len(text) and (text[end] in ALNUM or text[end] in " -" and end + 1 < len(text) and text[end + 1] in ALNUM) and end - start < 48:
        if text[end] == " " and not (text[end + 1] in DIGITS or text[end + 1].isupper()):
            break
        end += 1
    code = text[start:end].replace(" ", "").replace("-", "")
    if _iban_ok(code.upper()) or len(code) >= 6 and code.isascii() and code.isdigit():
        return start, end
    if 6 <= len(code) <= 20 and code.isalnum() and code.isupper() and sum(c in DIGITS for c in code) >= 5:
        return start, end
    return None


def _address_before(text: str, i: int, end: int) -> tuple[int, int] | None:
    """House number and one to three capitalised words before a street suffix at ``i``."""
    if end < len(text) and text[end].isalnum():
        return None
    start, words = i, 0
    while words < 4:
        word_start = start
        while word_start and text[word_start - 1].isalnum():
            word_start -= 1
        word = text[word_start:start]
        if not word:
            return None
        if word.isascii() and word.isdigit() and len(word) <= 6:
            return (word_start, end) if words else None
        if not word[0].isupper() or word_start == 0 or text[word_start - 1] != " ":
            return None
        words, start = words + 1, word_start - 1
    return None


def _spelled_email(text: str, at_start: int, at_end: int) -> tuple[int, int] | None:
    start = at_start
    while start and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at_end, LABEL)
    if start == at_start or end == at_end:
        return None
    for dot in DOT_WORDS:
        if text.startswith(dot, end):
            stop = _run(text, end + len(dot), LABEL)
            top = text[end + len(dot) : stop]
            if 2 <= len(top) <= 6 and top.isalpha():
                return start, stop
    return None


def find_spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, in order of start and kind."""
    if not text:
        return []
    folded = text.lower()
    if len(folded) != len(text):
        folded = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)

    def keep(kind: str, start: int, end: int, good: bool = True) -> None:
        if good and start >= past[kind]:
            found.append((start, end, kind))
        past[kind] = max(past[kind], end)

    for last, (what, size) in automaton.iter(folded):
        i = last - size + 1
        if what == "digit":
            if i >= past["ip"] and (i == past["ip"] or text[i - 1] not in DIGITS) and (hit := _ip_at(text, i)):
                keep("ip", i, *hit)
            if i >= past["card"]:
                end = _card_end(text, i)
                if end > i + 1:
                    digits = text[i:end].replace(" ", "").replace("-", "")
                    keep("card", i, end, 14 <= len(digits) <= 19 and _luhn(digits))
        elif what == "at":
            if hit := _email_at(text, i, past["email"]):
                keep("email", *hit)
        elif what == "plus":
            if i >= past["phone"] and (end := _phone_at(text, i)):
                keep("phone", i, end, 10 <= sum(c in DIGITS for c in text[i:end]) <= 15)
        elif what == "scheme":
            # a scheme inside a URL is part of it: each run is read once
            if i >= past["url"] and (i == 0 or not text[i - 1].isalnum()):
                end = i + size
                while end < len(text) and text[end] not in URL_END:
                    end += 1
                run_end = end
                while end > i + size and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > i + size:
                    keep("url", i, end)
                past["url"] = max(past["url"], run_end)
        elif what == "account":
            if (i == 0 or not text[i - 1].isalnum()) and (hit := _account_after(text, i + size)):
                keep("account", *hit)
        elif what == "street":
            if hit := _address_before(text, i, i + size):
                keep("address", *hit)
        elif hit := _spelled_email(text, i, i + size):
            keep("email_obfuscated", *hit)
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


BASE_KINDS = KINDS[:4]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``spans``, an array of (kind, start, end).

    Offsets are code points, end exclusive.  Null and empty texts have no
    spans; texts may be of any length and take time in proportion to it;
    repeated rows are scanned each on its own; other columns of the input are
    not read, whatever their names.  A null id is passed on.  An empty table
    gives an empty one.  Nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        auto = build_automaton()
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in small_batches(batches):
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t, auto)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(span))], names=["id", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        scan, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    ).withColumnRenamed("id", id_col)


def digest_sql(spans: str) -> str:
    """SQL for ``kind:start:end`` of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
