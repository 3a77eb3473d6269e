"""Plain Python forms of the operators, for comparison."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(1 << 63)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """Index of the first of each one's component."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_duplicates(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text)."""
    fps = [simhash(t) for _, t in rows]
    roots = components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)]


def windows(rows, width=20):
    """(n_words, n_removed, kept_sha256) by (doc_id, text)."""
    seen, out = set(), {}
    for i, text in sorted({(LOW if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1]), r[1])):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        out[i, text] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def removed_bytes(rows, width=50):
    """Bytes that go, as flags, by (doc_id, text)."""
    first, texts = {}, {(LOW if i is None else i, t or "") for i, t in rows}
    for i, text in texts:
        data = text.encode()
        for k in range(len(data) - width + 1):
            s = data[k : k + width]
            first[s] = min(i, first.get(s, i))
    out = {}
    for i, text in texts:
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            if first[data[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out[i, text] = bytes(gone)
    return out


def suffix_row(text, gone):
    data = text.encode()
    return (len(data), sum(gone), len(re.findall(b"\1+", gone)), sha(bytes(x for x, g in zip(data, gone, strict=True) if not g)))


def suffix_text(text, gone):
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not any(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def personal(text):
    out = []
    for kind, form in FORMS.items():
        for m in form.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if good:
                out.append((kind, *m.span()))
    return out


def spans(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def likeness(a, b, width=24, stride=12):
    """Common start, common end, and spans between that are shared in order."""
    if not a or not b:
        return float(a == b)
    i = j = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    covered = p = q = 0
    for at in range(0, len(x) - width + 1, stride):
        if at < p or (other := y.find(x[at : at + width], q)) < 0:
            continue
        before = after = 0
        while at - before > p and other - before > q and x[at - before - 1] == y[other - before - 1]:
            before += 1
        while at + after < len(x) and other + after < len(y) and x[at + after] == y[other + after]:
            after += 1
        covered, p, q = covered + before + after, at + after, other + after
    return (i + j + covered) / max(len(a), len(b))
