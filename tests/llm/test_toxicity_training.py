"""Training of op6, and its score against a plain version that goes text by text, word by word, n-gram by n-gram."""

import numpy as np

from lensgraph.llm import toxicity


def plain_chance(model, text):
    """The score as the docstring says it."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 0x40 else 32 for c in text.encode())
    bags = []
    for word in folded.split(b" "):
        if not word:
            continue
        marked, bag = b" " + word + b" ", []
        for n in toxicity.GRAMS:
            for at in range(len(marked) - n + 1):
                h = n
                for c in marked[at : at + n]:
                    h = (h ^ c) * 0x100000001B3 % (1 << 64)
                bag.append(model.weights[(h ^ h >> 29) % toxicity.BUCKETS])
        bags.append(bag)
    every = [x for bag in bags for x in bag]
    high = max((sum(b) / max(1, len(b)) + model.bias for b in bags), default=model.bias)
    mean = sum(every) / max(1, len(every)) + model.bias
    return 1 / (1 + np.exp(-(model.slope * high + model.whole * mean + model.shift)))


def test_score_of_every_text():
    rng = np.random.default_rng(7)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS), 0.3, 0.9, 0.7, -0.4)
    texts = ["", " ", "a", "x!y", "Plain words, twice: plain Words", "ÜBER-cool ñandú 日本語 😀", "l33t @dmin", "long" * 500, *("".join(chr(int(c)) for c in rng.integers(32, 380, int(rng.integers(1, 60)))) for _ in range(200))]
    got = model.chance(toxicity._bags(texts))
    assert np.allclose(got, [plain_chance(model, t) for t in texts])


def test_pooling_learns_the_whole_text():
    """No single word tells, their share in the text does: the text's own mean bag is what counts."""
    rng = np.random.default_rng(2)
    bad, good = (["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7)) for _ in range(40)] for _ in range(2))
    texts, labels = [], []
    for i in range(600):
        n = 24 if i % 2 else 6
        picks = [bad[int(k)] for k in rng.integers(0, 40, n)] + [good[int(k)] for k in rng.integers(0, 40, 30 - n)]
        texts.append(" ".join(rng.permutation(picks)))
        labels.append(i % 2)
    labels = np.array(labels)
    model = toxicity.fit(texts, labels)
    assert ((model.chance(toxicity._bags(texts)) >= 0.5) == labels).mean() > 0.9 and model.whole > 0.5


def test_words_of_clean_texts_too_begin_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 1)  # the first windows alone
    rng = np.random.default_rng(1)
    filler = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(200)]
    texts, labels = [], []
    for i in range(800):
        y = i % 2
        words = [filler[int(k)] for k in rng.integers(0, 200, 12)]
        if rng.random() < (0.9 if y else 0.25):
            words[3] = "zorvex"
        texts.append(" ".join(words))
        labels.append(y)
    model = toxicity.fit(texts, np.array(labels, np.int64))
    high, _ = toxicity._bags(["zorvex", *filler]).best(model.weights, model.bias)
    assert high[0] > np.quantile(high[1:], 0.95)


def test_slight_excess_of_common_words_begins_no_window():
    """Toxic texts are longer here, so they hold every common word somewhat more often; what tells are words that only they hold."""
    rng = np.random.default_rng(5)
    common, bad = (["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(n)] for n in (20, 10))
    texts, labels = [], []
    for i in range(3000):
        y = i % 2
        words = [common[int(k)] for k in rng.integers(0, 20, 20 if y else 15)]
        words[3] = bad[int(rng.integers(10))] if y else words[3]
        texts.append(" ".join(words))
        labels.append(y)
    labels = np.array(labels)
    model = toxicity.fit(texts[:2000], labels[:2000])
    assert ((model.chance(toxicity._bags(texts[2000:])) >= 0.5) == labels[2000:]).mean() > 0.98
    high, _ = toxicity._bags([*bad, *common]).best(model.weights, model.bias)
    assert high[:10].min() > high[10:].max()
