"""Plain versions of operators, for comparison."""

import re

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    """(kind, start, end) of the base kinds, by kind and place."""
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in re.sub(r"[^0-9.]", "", m[0]).split(".") if x), "card": 13 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in double) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def added_spans(text):
    """IBANs, and national identifiers with a word of context within 40 characters."""
    from tidemark.llm.pii import IBAN_LENGTHS

    lengths = {c: n for n, own in IBAN_LENGTHS.items() for c in own.split()}
    out, at = [], 0
    while m := re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}").search(text, at):
        at = m.start() + 1
        whole = re.compile(rf"[A-Z0-9](?: ?[A-Z0-9]){{{lengths[m[1]] - 1}}}(?![A-Za-z0-9])").match(text, m.start()) if m[1] in lengths else None
        if whole:
            bare = whole[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                out.append(("iban", *whole.span()))
            at = whole.end()
    for m in re.finditer(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", text):
        near = text[max(0, m.start() - 40) : m.start()].lower() + "\n" + text[m.end() : m.end() + 40].lower()
        if re.search("ssn|social|security|national", near) and m[0][:3] not in ("000", "666") and m[0][0] != "9":
            out.append(("national_id", *m.span()))
    return out


def redacted(text):
    if text is None:
        return None
    order = ["email", "ip", "card", "phone", "iban", "national_id"]
    out, at, reach = [], 0, -1
    for kind, a, b in sorted(base_spans(text) + added_spans(text), key=lambda s: (s[1], -s[2], s[0])):
        assert kind in order
        if a >= reach:
            out += [text[at:a] if at <= a else "", f"[{kind.upper()}]"]
        reach = max(reach, b)
        at = reach
    return "".join(out) + text[at:]


def runs_covered(rows):
    """Cleaned texts by (id, text): every run of two or more consecutive sentences that holds 16 words, repeated anywhere,
    loses its places but the first. Of a start's runs, those that are longer by more than three sentences than any that
    could be shortest are left out."""
    from tidemark.llm import substrings

    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, covered, runs = {}, {}, []
    for i, t in distinct:
        p = substrings.sentences(t or "")
        w = [x.lower().split() for x in p]
        for a in range(len(p)):
            words, extra = 0, 0
            for e in range(a + 1, len(p) + 1):
                words += len(w[e - 1])
                if not w[a] or extra > 3:
                    break
                if e - a >= 2 and words >= substrings.LEAST_WORDS:
                    runs.append((tuple(map(tuple, w[a:e])), (i, t), a, e))
                    extra += e - a > 2 and words - len(w[a]) >= substrings.LEAST_WORDS
    for key, doc, a, _ in runs:
        first.setdefault(key, (doc, a))
    for key, doc, a, e in runs:
        if first[key] != (doc, a):
            covered.setdefault(doc, set()).update(range(a, e))
    return {(i, t): None if t is None else "".join(x for k, x in enumerate(substrings.sentences(t)) if k not in covered.get((i, t), ())) for i, t in distinct}
