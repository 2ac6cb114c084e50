"""Words that only a weak hash takes for one another: the hash itself, and the operators that trust it."""

import random

import numpy as np
import pytest

from cuesheet.llm import jaccard, passages, runtime, token_counts
from tests.llm.common import documents, similar


def thue_morse(n, one, two):
    """n letters of the Thue-Morse sequence over two letters."""
    return "".join((one, two)[i.bit_count() & 1] for i in range(n))


def spans(words):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends


def test_hashes_tell_words_apart():
    rnd = random.Random(1)
    words = [thue_morse(n, *p) for n in (8, 64, 1024, 2048, 4096) for p in ("et", "te", "ab", "ba", "in", "ni", "xo", "ox")]
    words += ["".join(rnd.choice("ab\x00") for _ in range(n)) for n in range(1, 80) for _ in range(40)]
    words = sorted(set(words))
    data, starts, ends = spans(words)
    for seed in (0, 1):
        assert len(np.unique(runtime.span_hashes(data, starts, ends, seed=seed))) == len(words)
    assert not np.any(runtime.span_hashes(data, starts, ends) == runtime.span_hashes(data, starts, ends, seed=1))
    twice, s2, e2 = spans(["Ab" * n for n in (1, 4, 5, 16, 17, 300)] + ["aB" * n for n in (1, 4, 5, 16, 17, 300)])
    folded, plain = (runtime.span_hashes(twice, s2, e2, fold_case=f) for f in (True, False))
    assert np.array_equal(folded[:6], folded[6:]) and not np.any(plain[:6] == plain[6:])


def test_equal_spans_compares_bytes():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 8, 9, 32, 33, 70]))) for _ in range(400)]
    words += [w[:-1] + "c" for w in words] + words[:50]
    data, starts, ends = spans(words)
    other = np.array([rnd.randrange(len(words)) for _ in words])
    other[-50:] = np.arange(50)
    assert runtime.equal_spans(data, starts, ends, other).tolist() == [w == words[o] for w, o in zip(words, other.tolist(), strict=True)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
@pytest.mark.parametrize("pair", ["et", "ab", "xo"])
def test_token_counts_of_colliding_words(n, pair):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"w {thue_morse(n, *pair)} w", f"w {thue_morse(n, *pair[::-1])} w"]
    library = Tokenizer.from_file(path)
    counter = token_counts.ArrayBpe(token_counts.read_tokenizer(path))
    assert counter.counts_of(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_do_not_rest_on_the_hash(monkeypatch):
    """With a hash of two bits pieces are told apart by their bytes, and the cache by nothing that is wrong."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    true = runtime.span_hashes
    monkeypatch.setattr(token_counts, "span_hashes", lambda *a, seed=0, **k: true(*a, seed=seed, **k) & np.uint64(3 if seed == 0 else (1 << 64) - 1))
    counter = token_counts.ArrayBpe(token_counts.read_tokenizer(path))
    rnd = random.Random(3)
    for _ in range(3):
        texts = [" ".join("".join(rnd.choice("abcdeé19.") for _ in range(rnd.randint(1, 12))) for _ in range(30)) for _ in range(20)]
        assert counter.counts_of(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_links_and_passages_of_colliding_words(spark):
    a, b = thue_morse(2048, "e", "t"), thue_morse(2048, "t", "e")
    texts = [f"{a} {b} {a} {a} {b}", f"{b} {a} {b} {b} {a}", f"{a} {b} {a} {a} {b}"]
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(documents(spark, texts)).collect()}
    assert got == similar(dict(enumerate(texts))) == {0: 0, 1: 1, 2: 0}
    apart = [" ".join(f"{w}{i}" for i in range(60)) for w in (a, b)]
    assert passages.repeated_passages(documents(spark, apart)).count() == 0
