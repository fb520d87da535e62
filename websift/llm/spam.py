"""Keyword-stuffed and link-list pages: features of a page's main body, weak labels, bagged trees, smoothing by host."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from websift.llm import trees

FEATURES = [
    "words", "distinct_share", "top_share", "top5_share", "sentence_share", "words_a_block", "short_share", "known_share", "separator_share", "joined_share", "host_share",
    "link_share", "repeat_share", "attr_words", "attr_distinct", "attr_known", "hidden_share", "skeleton_share", "same_line_share", "blocks", "bare_known", "repeated_share",
]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words): lower case, letters and digits only."""
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "))
    lists = pc.split_pattern(clean, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    empty = np.asarray(pc.equal(pc.utf8_length(clean), 0))
    if empty.any():
        keep = np.repeat(~empty, counts)
        flat = flat.filter(pa.array(keep))
        counts = np.where(empty, 0, counts)
    return counts, flat


def _by_page(page: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(page, values, n)


def _repeats(page: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent, count of the five most frequent) of each page."""
    pairs, counts = np.unique(page.astype(np.int64) * (1 << 32) + codes, return_counts=True)
    owner = pairs >> 32
    order = np.lexsort((-counts, owner))
    owner, counts = owner[order], counts[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return np.bincount(owner, minlength=n).astype(float), np.bincount(owner[rank == 0], counts[rank == 0], n), np.bincount(owner[rank < 5], counts[rank < 5], n)


def features(texts: pa.Array, page: np.ndarray, linked: np.ndarray, hidden: np.ndarray, attr_texts: pa.Array, attr_page: np.ndarray, n: int, known: pa.Array) -> np.ndarray:
    """(n pages, features). texts: the main blocks with their page, whether they are links and whether they are hidden; attr_texts: attribute texts.

    known: words of ordinary sentences. Pages without main text have 0 words and neutral shares.
    """
    ratio = lambda a, b: a / np.maximum(b, 1)
    counts, words = _tokens(texts)
    word_page = np.repeat(page, counts)
    total = np.bincount(page, counts, n)
    encoded = pc.dictionary_encode(words)
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    is_known = np.asarray(pc.is_in(encoded.dictionary, value_set=known))[codes] if len(codes) else np.zeros(0, bool)
    distinct, top, top5 = _repeats(word_page, codes, n)
    repeat = np.zeros(len(codes))
    repeat[1:] = (codes[1:] == codes[:-1]) & (word_page[1:] == word_page[:-1])
    full = np.asarray(pc.match_substring_regex(texts, r"[.!?…][\"'»”)\]]*\s*$"))
    separators = pc.count_substring_regex(texts, r"\s[|/·•–-]\s|[,#_+=]").to_numpy().astype(float)
    joined = pc.count_substring_regex(texts, r"\p{L}[_-]\p{L}|#\p{L}|\+\p{L}").to_numpy().astype(float)
    hosts = pc.count_substring_regex(texts, r"\b[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}\b").to_numpy().astype(float)
    blocks = np.bincount(page, minlength=n).astype(float)
    block_known = np.zeros(len(page))
    if len(codes):
        block_known = np.bincount(np.repeat(np.arange(len(page)), counts), is_known, len(page)) / np.maximum(counts, 1)

    # Skeletons: a sentence with a blank for each word that stands once on its page; sentences that only vary a keyword share it.
    sentences = pc.split_pattern_regex(texts, r"[.!?]\s+")
    per = pc.list_value_length(sentences).to_numpy(zero_copy_only=False).astype(np.int64)
    s_counts, s_words = _tokens(pc.list_flatten(sentences))
    s_page = np.repeat(page, per)
    s_codes = pc.dictionary_encode(s_words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(s_counts)), s_counts)
    _, inverse, often = np.unique(s_page[owner] * (1 << 32) + s_codes, return_inverse=True, return_counts=True)
    kept = often[inverse] > 1
    place = np.arange(len(s_codes)) - np.repeat(np.cumsum(s_counts) - s_counts, s_counts)
    mixed = (np.where(kept, s_codes + 2, 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    skeleton = np.zeros(len(s_counts), np.uint64)
    np.add.at(skeleton, owner, mixed)
    held = np.bincount(owner, kept, len(s_counts))
    long = (s_counts >= 4) & (held >= 2) & (held < s_counts)
    varied = _share_of_repeats(s_page, np.where(long, skeleton, np.arange(len(s_counts)).astype(np.uint64)), n)
    whole = np.zeros(len(s_counts), np.uint64)
    np.add.at(whole, owner, (s_codes.astype(np.uint64) + np.uint64(2)) * (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    repeated = _share_of_repeats(s_page, whole, n)
    lines = pc.dictionary_encode(texts).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_distinct, _, _ = _repeats(page, lines, n)

    ac, aw = _tokens(attr_texts)
    a_page = np.repeat(attr_page, ac)
    a_enc = pc.dictionary_encode(aw)
    a_codes = a_enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    a_total = np.bincount(attr_page, ac, n)
    a_distinct, _, _ = _repeats(a_page, a_codes, n)
    a_known = np.bincount(a_page, np.asarray(pc.is_in(a_enc.dictionary, value_set=known))[a_codes] if len(a_codes) else np.zeros(0), n)

    value = {
        "words": total, "distinct_share": np.where(total > 0, ratio(distinct, total), 1), "top_share": ratio(top, total), "top5_share": ratio(top5, total),
        "sentence_share": ratio(_by_page(page, counts * full.astype(float), n), total), "words_a_block": ratio(total, blocks), "short_share": ratio(_by_page(page, counts * (counts <= 6).astype(float), n), total),
        "known_share": np.where(total > 0, ratio(np.bincount(word_page, is_known, n), total), 1), "separator_share": ratio(_by_page(page, separators, n), total), "joined_share": ratio(_by_page(page, joined, n), total),
        "host_share": ratio(_by_page(page, hosts, n), total), "link_share": ratio(_by_page(page, counts * linked.astype(float), n), total), "repeat_share": ratio(np.bincount(word_page, repeat, n), total),
        "attr_words": a_total, "attr_distinct": np.where(a_total > 0, ratio(a_distinct, a_total), 1), "attr_known": np.where(a_total > 0, ratio(a_known, a_total), 1),
        "hidden_share": ratio(_by_page(page, counts * hidden.astype(float), n), total), "skeleton_share": varied, "same_line_share": 1 - ratio(line_distinct, blocks) * (blocks > 0) - (blocks == 0),
        "blocks": blocks, "bare_known": ratio(_by_page(page, counts * (block_known < 0.5), n), total), "repeated_share": repeated,
    }
    return np.stack([value[f] for f in FEATURES], axis=1).astype(float)


def _share_of_repeats(page: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Of each page, the share of values that stand three times or more on it."""
    if not len(page):
        return np.zeros(n)
    _, page_codes = np.unique(codes, return_inverse=True)
    pairs, inverse, counts = np.unique(page.astype(np.int64) * (1 << 32) + page_codes, return_inverse=True, return_counts=True)
    many = counts[inverse] >= 3
    return np.bincount(page, many, n) / np.maximum(np.bincount(page, minlength=n), 1)


def has_words(x: np.ndarray) -> np.ndarray:
    """Pages with a word in their main body or attributes; others can't be stuffed."""
    return (x[:, FEATURES.index("words")] > 0) | (x[:, FEATURES.index("attr_words")] > 0)


_WORD = re.compile(r"[^\W\d_]+")


def function_words(samples: list[tuple[str | None, str | None]], most: int = 30) -> set[str]:
    """The most frequent words of each language's samples."""
    counts: dict[str, Counter] = {}
    for la, t in samples:
        if la and t:
            counts.setdefault(la, Counter()).update(_WORD.findall(t.lower()))
    return {w for c in counts.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]}


def weak_label(text: str | None, attrs: str, common: set[str]) -> int:
    """1 spam, 0 content, -1 undecided: from sources that the features do not see, the exported text of a page and how its words are used.

    Each rule looks at one thing: how many of the text's words are function words (keywords have none, sentences need them), how
    well the text can be compressed (sentences that only vary a keyword), how many lines end as sentences do (lists of links), and the
    function words of the attributes. No feature is one of these.
    """
    words, held = _WORD.findall((text or "").lower()), _WORD.findall(attrs.lower())
    share = sum(w in common for w in words) / max(len(words), 1)
    held_share = sum(w in common for w in held) / max(len(held), 1)
    data = (text or "").encode("utf-8", "replace")
    packed = len(zlib.compress(data)) / len(data) if len(data) >= 200 else 1.0
    lines = [x for x in (text or "").split("\n") if x.strip()]
    open_lines = sum(x.rstrip()[-1:] not in ".!?…\"»”)" for x in lines) / max(len(lines), 1)
    stuffed_attrs = len(held) >= 20 and held_share < 0.13
    if stuffed_attrs or (len(words) >= 6 and share < 0.18) or packed < 0.3 or (len(lines) >= 8 and open_lines > 0.8 and share < 0.25):
        return 1
    if (share > 0.26 or not words) and packed > 0.34 and (len(held) < 15 or held_share > 0.15):
        return 0
    return -1


def fit(x: np.ndarray, labels: np.ndarray) -> list[trees.Tree]:
    """Bagged trees on the pages with a weak label."""
    keep = labels >= 0
    return trees.fit(x[keep], labels[keep])
