import random

from inkmesh.llm import licenses

INDEX = licenses.build_index()


def labels(text):
    return sorted(licenses.scan(licenses.words_of(text), INDEX)[0])


def template(label, k=-1):
    return [t for x, t, _ in licenses.TEMPLATES if x == label][k]


def test_versions_and_clauses_are_told_apart():
    for label in ("bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "agpl-3.0", "zlib", "unlicense", "mpl-2.0"):
        assert labels("Some words before. " + template(label).upper() + " and behind") == [label], label
    assert labels("either version 2 of the License") == [] and labels("free software for any purpose, as is") == []


def test_words_put_in_left_out_or_replaced():
    rng = random.Random(3)
    long = [(x, t, keys) for x, t, keys in licenses.TEMPLATES if len(t.split()) > 40]
    for label, t, keys in long:
        for _ in range(5):
            w, held = t.split(), {k for p in keys for k in p.split()}
            for _ in range(6):
                at = rng.randrange(len(w) - 1)
                if w[at] not in held and w[at + 1] not in held:
                    w[at : at + 1] = rng.choice(([], ["company"], [w[at], "or", "company"]))
            assert label in labels("x y z " + " ".join(w)), (label, w)
    grant = template("mit").replace("any person", "any person or company")
    assert labels(grant) == ["mit"]


def test_the_index_finds_what_all_places_give():
    """Brute force: every template aligned at every place, without an index."""
    rng = random.Random(4)
    for n in range(40):
        _, t, _ = rng.choice(licenses.TEMPLATES)
        w = t.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [w[at], "foo"], ["bar"]))
        noise = lambda k: [rng.choice("the of and software license in copy a1 b2 c3 public work".split()) for _ in range(k)]
        words = licenses.words_of(" ".join(noise(rng.randrange(30)) + w + noise(rng.randrange(30))))
        everywhere = [(k, b) for k, t in enumerate(INDEX.words) for b in range(-len(t), len(words))]
        assert licenses.scan(words, INDEX)[0].keys() == licenses.scan(words, INDEX, places=everywhere)[0].keys(), " ".join(map(bytes.decode, words))
