"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard(docs):
    sets = {}
    for i, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = smallest_reachable(ids, links)
    return {i: (len(sets[i]), component[i]) for i in ids}


def base_features(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if count[window] > 1:
            covered.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def repeats(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def vectors(rows, least=0.9):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            n = math.sqrt(sum(x * x for x in v))
            unit[i] = [x / n for x in v]
    ids = sorted(i for i, _ in rows)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if a in unit and b in unit and len(unit[a]) == len(unit[b]) and sum(p * q for p, q in zip(unit[a], unit[b], strict=True)) >= least]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    component = smallest_reachable(ids, links)
    return {i: (degree[i], component[i], component[i] == i) for i in ids}


def _stream(key, label, seed):
    return hashlib.sha256(f"{key}|{label}|{seed}".encode()).hexdigest()


def _shifted(half, stream, alphabets):
    out = []
    for i, c in enumerate(half):
        own = next((a for a in alphabets if c in a), None)
        out.append(own[(own.index(c) + int(stream[2 * (i % 32) : 2 * (i % 32) + 2], 16)) % len(own)] if own else c)
    return "".join(out)


def permute_text(v, key, alphabets):
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    for r in range(8):
        if r % 2 == 0:
            a = _shifted(a, _stream(key, r, b), alphabets)
        else:
            b = _shifted(b, _stream(key, r, a), alphabets)
    return a + b


def permute_index(v, radix, key):
    a, b = v % radix[0], v // radix[0]
    for r in range(8):
        if r % 2 == 0:
            a = (a + int(_stream(key, r, b)[:12], 16)) % radix[0]
        else:
            b = (b + int(_stream(key, r, a)[:12], 16)) % radix[1]
    return b * radix[0] + a


def _luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _read_date(d, m, y):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def pseudonym(v, key, alphabets):
    """The pseudonym of one found value; dates that can only be read month first are not handled here."""
    plain, digits = alphabets, re.sub("[^0-9]", "", v)
    if "@" in v:
        tld = re.search(r"\.[^\W\d_]+$", v)[0]
        return permute_text(v[: -len(tld)], f"{key}|mail", plain) + tld
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        area, group, serial = int(v[:3]), int(v[4:6]), int(v[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return v
        moved = permute_index((area - 1 - (area > 666)) * 99 + group - 1 + (serial - 1) * 898 * 99, (898 * 99, 9999), f"{key}|ssn")
        head, tail = moved % (898 * 99), moved // (898 * 99)
        return f"{head // 99 + 1 + (head // 99 >= 665):03d}-{head % 99 + 1:02d}-{tail + 1:04d}"
    if v[0] in "+(" or re.match(r"\d{3}-\d{3}-", v):
        if not 8 <= len(digits) <= 15:
            return v
        two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
        head = "" if v[0] != "+" else digits[0] if digits[0] in "17" else digits[:2] if digits[:2] in two else digits[:3]
        moved = iter(head + permute_text(digits[len(head) :], f"{key}|phone", plain))
        return "".join(next(moved) if c.isdigit() else c for c in v)
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)|(\d\d?)([./])(\d\d?)[./](\d{4})", v):
        day = _read_date(m[3], m[2], m[1]) if m[1] else _read_date(m[4], m[6], m[7])
        if day is None or not 1900 <= day.year <= 2099:
            return v
        first = datetime.date(1900, 1, 1)
        moved = first + datetime.timedelta(permute_index((day - first).days, (17, 4297), f"{key}|date"))
        if m[1]:
            return f"{moved:%Y-%m-%d}"
        return f"{moved.day:02d}{m[5]}{moved.month:02d}{m[5]}{moved.year}" if len(v) == 10 else f"{moved.day}{m[5]}{moved.month}{m[5]}{moved.year}"
    if re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", v):
        parts = [int(p) for p in v.split(".")]
        moved = permute_text("".join(f"{p:02x}" for p in parts if p < 256), f"{key}|ipv4", ("0123456789abcdef",))
        return ".".join(str(int(moved[k : k + 2], 16)) for k in range(0, 8, 2)) if max(parts) < 256 else v
    for pattern, own in ((r"[0-9a-f]{32,64}", "0123456789abcdef"), (r"[0-9A-F]{32,64}", "0123456789ABCDEF")):
        if re.fullmatch(pattern, v):
            return permute_text(v, f"{key}|secret", (own,))
    if not _luhn(digits):
        return v
    body = permute_text(digits[:-1], f"{key}|card", plain)
    new = iter(next(body + str(c) for c in range(10) if _luhn(body + str(c))))
    return "".join(next(new) if c.isdigit() else c for c in v)


def log_ratios(texts, trusted, buckets, smoothing):
    """The mean over words and pairs of neighbouring words of log(target / raw), for each text; ``buckets`` maps a list of
    words to their n-grams' buckets."""
    raw, target = Counter(), Counter()
    for i, text in texts.items():
        grams = buckets(WORD.findall(text or ""))
        raw.update(grams)
        if i in trusted:
            target.update(grams)
    n = 1 << 16
    share = lambda c, b: math.log((c[b] + smoothing) / (sum(c.values()) + smoothing * n))
    known = {b: share(target, b) - share(raw, b) for b in raw}
    return {i: (sum(known[b] for b in g) / len(g) if g else 0.0) for i, g in ((i, buckets(WORD.findall(t or ""))) for i, t in texts.items())}
