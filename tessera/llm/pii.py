"""Personal data in texts: anchors found in one Aho-Corasick pass, local parsers that expand and check them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_texts

#: Kinds in the order of a document's spans; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "address", "account"]
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: A scheme's authority that names a person: user data before an at-sign.
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]++@[A-Za-z0-9.-]+(?::[0-9]{1,5})?")
OBFUSCATED = re.compile(r"\s{0,2}[A-Za-z0-9-]+(?:\s{0,2}[\[(]dot[\])]\s{0,2}[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
IDENTIFIER = re.compile(r"""["']?(?:\s{1,3}(?:no\.?|number|id))?\s{0,3}[:=#]\s{0,3}["']?([A-Za-z0-9][A-Za-z0-9_/+.-]{4,}[A-Za-z0-9])""")
IBAN = re.compile(r"[\s:]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
CUES = ["account", "api_key", "apikey", "iban", "passport", "passwd", "password", "secret", "ssn", "token"]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("[at]", "obfuscated"), ("(at)", "obfuscated")):
        found.add_word(word, what)
    for digit in "0123456789":
        found.add_word(digit, "digit")
    for cue in CUES:
        for word in {cue, cue.capitalize(), cue.upper()}:
            found.add_word(word, "iban" if cue == "iban" else "cue")
    found.make_automaton()
    return found


class Finder:
    """Spans of one text after another: lists of (kind, start, end) in code points, by kind, then start."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys([*KINDS, "digits"], 0)  # where each kind's next match may begin

        def take(kind: str, start: int, end: int, keep: bool) -> None:
            done[kind] = end
            if keep:
                found[kind].append((start, end))

        for last, what in self.anchors.iter(text):
            if what == "digit":
                if last >= done["ip"] and last >= done["digits"]:
                    if m := IP.match(text, last):
                        take("ip", last, m.end(), all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()))
                    else:
                        done["digits"] = DIGITS.match(text, last).end()
                if last >= done["card"] and (m := CARD.match(text, last)):
                    digits = re.sub("[ -]", "", m[0])
                    take("card", last, m.end(), 16 <= len(digits) <= 19 and _luhn(digits))
            elif what == "at":
                start = last
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last + 1)):
                    take("email", start, m.end(), True)
            elif what == "plus":
                if last >= done["phone"] and (m := PHONE.match(text, last)):
                    take("phone", last, m.end(), 8 <= sum(c.isdigit() for c in m[0]) <= 15)
            elif what == "scheme":
                start = last - 2
                while start > done["address"] and text[start - 1] in SCHEME:
                    start -= 1
                while start < last - 2 and not text[start].isalpha():  # it begins with a letter
                    start += 1
                if start < last - 2 and (m := USERINFO.match(text, last + 1)):
                    take("address", start, m.end(), True)
            elif what == "obfuscated":
                end = last - 3
                while end > done["address"] and last - 3 - end < 2 and text[end - 1] == " ":
                    end -= 1
                start = end
                while start > done["address"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < end and (m := OBFUSCATED.match(text, last + 1)):
                    take("address", start, m.end(), True)
            elif last >= done["account"]:
                if what == "iban" and (m := IBAN.match(text, last + 1)):
                    take("account", *m.span(1), _iban_holds(m[1]))
                elif (m := IDENTIFIER.match(text, last + 1)) and any(c.isdigit() for c in m[1]):
                    take("account", *m.span(1), True)
        return [(kind, s, e) for kind in KINDS for s, e in found[kind]]


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all but the text by default) and ``spans`` of each document.

    A span is (kind, start, end), in code points, end exclusive, sorted by kind in the order of ``KINDS``,
    then start. Base kinds (email, ip, card, phone) never overlap within a kind; address (urls with user
    data, obfuscated mail addresses) and account (identifiers after a cue, IBANs) are additions. Null and
    empty texts have none; a column called spans is replaced.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c != "spans"]

    def make():
        find = Finder()
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts]]

    return map_texts(docs, text_col, keep, [T.StructField("spans", SPANS)], make)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans become one."""

    def make():
        find = Finder()

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for kind, start, end in sorted(find(text), key=lambda x: x[1:]):
                if end <= at:
                    continue
                if start >= at:
                    out += [text[at:start], f"[{kind}]"]
                at = end
            return "".join([*out, text[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    keep = [c for c in docs.columns if c != text_col]
    return map_texts(docs, text_col, keep, [T.StructField(text_col, T.StringType())], make).select(*docs.columns)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``spans``."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(
        id_col, *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )
