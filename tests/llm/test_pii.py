import re

from hypothesis import given, settings
from hypothesis import strategies as st

from phenogrid.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[0::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


AUTO = pii.build_automaton()
PIECES = st.sampled_from(["a@b.co", "@", ".", "x.y@z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0100", "+", "12", " ", "-", "(", ")", "3.4", "é", "%", "\U0001f600", "İ", "49"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find_spans(text, AUTO) if s[2] in pii.BASE_KINDS] == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.text("01 49.-+@ab()", max_size=60))
def test_base_spans_on_random_text(text):
    assert [s for s in pii.find_spans(text, AUTO) if s[2] in pii.BASE_KINDS] == brute(text)


def kinds(text):
    return {(k, text[s:e]) for s, e, k in pii.find_spans(text, AUTO) if k not in pii.BASE_KINDS}


def test_added_kinds():
    assert ("account", "DE89370400440532013000") in kinds("IBAN: DE89370400440532013000 bitte")
    assert ("account", "123-45-6789") in kinds("her SSN 123-45-6789.")
    assert ("address", "12 Old Mill Road") in kinds("lives at 12 Old Mill Road, here")
    assert ("url", "https://example.com/a?b=1") in kinds("see https://example.com/a?b=1.")
    assert ("email_obfuscated", "jane.doe [at] example [dot] org") in kinds("mail jane.doe [at] example [dot] org now")
    assert not kinds("the account of the road, at an address on this street, was clean")


def test_odd_rows(odd_documents, no_documents):
    rows = {(r["doc_id"], len(r["spans"])) for r in pii.find_pii(odd_documents).collect()}
    assert (2, 0) in rows and (3, 0) in rows and (9, 3) in rows
    assert pii.find_pii(odd_documents).count() == 12 and pii.find_pii(no_documents).count() == 0


def test_many_schemes_in_one_run_take_linear_time():
    import time

    began = time.time()
    for text in ("http://" * 100_000, "xhttp://" * 100_000, "http://;" * 100_000):
        spans = pii.find_spans(text, pii.build_automaton())
        assert [k for _, _, k in spans] in ([], ["url"])
    assert time.time() - began < 20
