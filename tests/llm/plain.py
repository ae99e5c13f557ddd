"""Hashes of words in plain Python, for brute-force versions of operators that hash."""

from tidemark.llm import common

MASK = (1 << 64) - 1


def mix(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & MASK
    return h ^ h >> 31


def word_hash(word: bytes) -> int:
    total = 0
    for i, b in enumerate(word):
        total += int(common._BYTE_VALUE[b]) * pow(int(common._BASE), i, 1 << 64)
    return mix((total + len(word)) & MASK)


def words(text: str) -> list[bytes]:
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return lower.split()


def ngram_hash(hashes: list[int]) -> int:
    h = (hashes[0] + len(hashes)) & MASK
    for x in hashes[1:]:
        h = (mix(h * int(common._NEXT) & MASK) + x) & MASK
    return mix(h)
