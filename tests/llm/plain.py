"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import html
import itertools
import re

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, words: int) -> set[str]:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    if len(found) < words:
        return {" ".join(found)} if found else set()
    return {" ".join(found[k : k + words]) for k in range(len(found) - words + 1)}


def near_components(texts: dict[int, str | None], words: int, percent: int) -> dict[int, int]:
    """Least reachable id of each document, all pairs compared."""
    sets = {k: shingles(t, words) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        either = len(sets[a] | sets[b])
        if both and 100 * both >= percent * either:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(number[::-1]):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text: str) -> list[tuple[int, int, str]]:
    found = [(0, m) for m in EMAIL.finditer(text)]
    found += [(1, m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, m) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(3, m) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    found.sort(key=lambda f: (f[1].start(), f[0]))
    return [(m.start(), m.end(), ("email", "ip", "card", "phone")[k]) for k, m in found]


def kept_exact(rows: list[tuple[int, str | None]]) -> dict[str, int]:
    """Largest id of each text."""
    best: dict[str, int] = {}
    for key, text in rows:
        best[text or ""] = max(key, best.get(text or "", key))
    return best


BLOCK = "address|article|blockquote|center|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|li|main|ol|p|pre|section|table|tbody|td|th|tr|ul"
GONE = "aside|button|fieldset|footer|form|header|iframe|label|nav|noscript|script|select|style|svg|textarea"


def article_text(page: str) -> str:
    """The article of a page whose markup is sound, by patterns alone."""
    page = re.sub(r"(?is)<!--.*?-->", "", page)
    body = re.search(r"(?is)<article\b[^>]*>(.*)</article>", page)[1]
    body = re.sub(rf"(?is)<({GONE})\b.*?</\1>", "", body)
    body = re.sub(r"(?is)<(div|section|p|ul)\b[^>]*\b(class|id)=[\"']?(ad|ads|comments|share|related)\b.*?</\1>", "", body)
    # White space of the source is one blank; only blocks end a line.
    body = re.sub(rf"(?i)</?({BLOCK})\b[^>]*>", "\n", " ".join(body.split()))
    body = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\b[^>]*>", " ", body)))
    lines = (" ".join(line.split()) for line in body.split("\n"))
    return "\n".join(line for line in lines if line)
