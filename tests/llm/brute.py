"""Plain versions of the operators for small inputs."""

import re

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, n=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=4):
    """{doc_id: smallest id reached} of (doc_id, fp)."""
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in fps}


def kept_spans(text, patterns):
    """(start, kind, end) of fixed patterns: (pattern, test) by kind."""
    found = []
    for kind, (pattern, test) in enumerate(patterns):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if test(m)]
    return sorted(found)


def number(span):
    return re.sub("[^0-9]", "", span)


def luhn(span):
    total = 0
    for k, c in enumerate(reversed(number(span))):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


PII = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(number(m[0])) <= 19 and luhn(m[0])),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(number(m[0])) <= 15),
)
SECRETS = (
    (
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m[2]) >= 6,
    ),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    duplicates = sum(x in lines[:k] for k, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, duplicates, len(inside), failed
