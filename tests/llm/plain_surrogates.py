"""Surrogates once more in plain Python: one text at a time, hmac from the library, collisions by dictionaries."""

import hashlib
import hmac
from collections import Counter

import regex

from lectern.llm import pii

CASES = {t: g for g, ts in pii.TITLES.items() for t in ts}
LISTED = {n: g for g, ns in pii.GIVEN.items() for n in ns}
TITLE = regex.compile(rf"^(?:{'|'.join(sorted(CASES, key=len, reverse=True))})\.? ")
PREFIX = regex.compile(r"^(AKIA|ASIA|eyJ|(?:sk|pk|ghp|gho|ghs|xoxb|xoxp|glpat)(?=[-_]))")


def kind_of(m):
    return next((k for k, p in pii.PATTERNS[:-1] if regex.fullmatch(p, m)), "person")


def digest(key, *parts):
    return hmac.new(key.encode(), "\x1f".join(parts).encode(), hashlib.sha512).hexdigest()


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10


def initcap(x):
    return x[:1].upper() + x[1:].lower()


def found_in(text):
    """(start, stop, mention, kind, names) of every entity of a text."""
    static = [(m.start(), m.end(), m.group()) for m in regex.finditer(pii.ANY, text)]
    seen = []
    for _, _, m in static:
        if kind_of(m) == "person":
            head = TITLE.match(m)
            title = CASES.get(head.group().strip(" .").replace(".", ""), "n") if head else "n"
            words = m[head.end() if head else 0 :].split(" ")
            for i, w in enumerate(words):
                own = LISTED.get(initcap(w))
                seen.append((w.lower(), w, i < len(words) - 1 or (len(words) == 1 and own is not None), title if title != "n" else own or "n"))
    kinds = {}
    for norm, *_ in seen:
        given = [g for n, _, is_given, g in seen if n == norm and is_given]
        kinds[norm] = "given-" + next((g for g in given if g != "n"), "n") if given else "surname"
    shown = {y for _, w, *_ in seen for y in (w, w.upper(), initcap(w)) if len(y) > 1}
    if not any(len(w) > 1 for _, w, *_ in seen):
        return [(*x, kind_of(x[2]), kinds) for x in static]
    either = "(?:" + "|".join(map(regex.escape, shown)) + ")"
    pattern = pii.ANY + rf"|(?<!\p{{L}}){either}(?: {either}){{0,3}}(?!\p{{L}})"
    return [(m.start(), m.end(), m.group(), kind_of(m.group()), kinds) for m in regex.finditer(pattern, text)]


def forms(m, kind, kinds):
    """(kind, norm, own) of an entity, or of each part of a person."""
    if kind == "person":
        head = TITLE.match(m)
        return [(kinds.get(w.lower(), "surname"), w.lower(), w.lower()) for w in m[head.end() if head else 0 :].split(" ")]
    body = m[: m.rindex(".")] if kind == "email" else m
    plain = regex.sub("[^A-Za-z0-9]", "", body).lower()
    if kind == "email":
        return [(kind, m.lower(), plain)]
    if kind == "phone":
        country = regex.match(r"^\+([0-9]{1,3})(?=[^0-9])", m)
        return [(kind, f"{len(country[1]) if country else 0}|{plain}", plain)]
    if kind in ("secret", "ip"):
        return [(kind, m, m if kind == "ip" else plain)]
    return [(kind, m.lower() if kind == "ip6" else plain, m.lower() if kind == "ip6" else plain)]


def core(key, kind, norm, own, mention, attempt):
    d = digest(key, kind, norm)
    hs = d if attempt == 0 else hashlib.sha512(f"{d}:{attempt}".encode()).hexdigest()
    byte = lambda i: int(hs[i % 64 * 2 : i % 64 * 2 + 2], 16)
    if kind == "ip":
        inside = 1 if regex.match(r"(?:10|127)\.", mention) else 2 if regex.match(r"(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.", mention) else 0
        out = []
        for i, x in enumerate(mention.split(".")):
            n, b = len(x) if attempt < pii.FREE_FORM else 0, byte(i)
            first = {3: 128 + b % 40, 2: 11 + b % 89, 1: 1 + b % 9, 0: 11 + b % 89}[n]
            out.append(x if i < inside else str(first if i == 0 else {3: 100 + b % 156, 2: 10 + b % 90, 1: b % 10, 0: b}[n]))
        return ".".join(out)
    if kind == "ip6":
        low = mention.lower()
        kept = regex.match(r"^(2001:0?db8:|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:)", low)
        n = len(kept[1]) if kept else 0
        return low[:n] + "".join(hs[i % 128] if c != ":" else c for i, c in enumerate(low) if i >= n)
    if kind.startswith("given") or kind == "surname":
        n = (4 if kind == "surname" else 3) + min(attempt, 40)
        back = hs[::-1]
        body = "".join(pii.CONSONANTS[int(hs[i], 16)] + pii.VOWELS[int(back[i], 16)] for i in range(n))
        latin = body + {"given-f": "a", "given-m": "n", "given-n": "e"}.get(kind, "s")
        for script, (a, b) in (("Cyrillic", pii.CYRILLIC), ("Greek", pii.GREEK)):
            if regex.search(rf"\p{{{script}}}", norm):
                return latin.translate(str.maketrans(a, b))
        for script, letters in pii.UNCASED.items():
            if regex.match(rf"\p{{{script}}}", norm):
                return "".join(letters[byte(i + 1) % len(letters)] for i in range(max(2, len(norm)) + attempt // 4))
        return latin
    country = regex.match(r"^\+([0-9]{1,3})(?=[^0-9])", mention)
    prefix = PREFIX.match(mention)
    held = {"secret": len(prefix[1]) if prefix else 0, "phone": len(country[1]) if country else 0, "iban": 2, "card": 1}.get(kind, 0)
    hexed = kind == "secret" and regex.fullmatch("[0-9A-Fa-f]+", mention)
    shape = own + "0" * max(0, attempt - pii.FREE_FORM)
    pick = lambda c, i: "0123456789"[byte(i) % 10] if c.isdigit() else "abcdef"[byte(i) % 6] if hexed else "abcdefghijklmnopqrstuvwxyz"[byte(i) % 26]
    ds = "".join(c if i < held else pick(c, i) for i, c in enumerate(shape))
    if kind == "card":
        return next(ds[:-1] + c for c in "0123456789" if luhn(ds[:-1] + c) == luhn(own))
    if kind == "iban":
        turned = "".join(str(int(c, 36)) for c in ds[4:] + ds[:2])
        return f"{ds[:2]}{98 - int(turned + '00') % 97:02}{ds[4:]}"
    return ds


def laid_out(mention, kind, drawn):
    body, tail = (mention[: mention.rindex(".")], mention[mention.rindex(".") :]) if kind == "email" else (mention, "")
    left, out = list(drawn), []
    for c in body:
        out.append(left.pop(0).upper() if c.isascii() and c.isupper() else left.pop(0) if c.isascii() and c.isalnum() else c)
    return "".join(out + left) + tail


def replaced(texts, key):
    places = [found_in(t) if t else [] for t in texts]
    whole = {}
    for row in places:
        for _, _, m, kind, kinds in row:
            for f in forms(m, kind, kinds):
                whole.setdefault(f[:2], (f[2], m))
    originals = {(k, own) for (k, _), (own, _) in whole.items()}
    attempts = dict.fromkeys(whole, 0)
    while True:
        drawn = {e: core(key, *e, *whole[e], n) for e, n in attempts.items()}
        holder = {}
        for e, x in sorted(drawn.items(), key=lambda y: (attempts[y[0]], digest(key, *y[0]))):
            holder.setdefault((e[0], x), e)
        wrong = [e for e, x in drawn.items() if holder[e[0], x] != e or (e[0], x) in originals]
        if not wrong:
            break
        last = max(attempts.values()) + 1 if any(attempts.values()) else 1
        for e in wrong:
            attempts[e] = last
    out = []
    for text, row in zip(texts, places, strict=True):
        done, at = "", 0
        for a, b, m, kind, kinds in row:
            if kind == "person":
                head = TITLE.match(m)
                words = m[head.end() if head else 0 :].split(" ")
                new = (head.group() if head else "") + " ".join(drawn[f[:2]].upper() if w.upper() == w and len(w) > 1 else initcap(drawn[f[:2]]) for w, f in zip(words, forms(m, kind, kinds), strict=True))
            else:
                (f,) = forms(m, kind, kinds)
                new = drawn[f[:2]] if kind in ("ip", "ip6") else laid_out(m, kind, drawn[f[:2]])
            done, at = done + text[at:a] + new, b
        out.append(done + text[at:] if text is not None else None)
    assert max(Counter((e[0], x) for e, x in drawn.items()).values(), default=1) == 1
    return out
