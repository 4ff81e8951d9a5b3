"""Texts made so that polynomial hashes modulo 2^64 agree must not pass for repeats."""

import numpy as np

from loomspan.llm import repeats


def colliding(letters=(97, 98)):
    """Two strings whose polynomial hashes agree for every odd base: a Thue-Morse word and its complement."""
    bits = np.array([bin(k).count("1") % 2 for k in range(1024)])
    return np.array(letters, np.uint8)[bits], np.array(letters, np.uint8)[1 - bits]


def test_hashes_collide_and_digests_do_not(spark):
    one, other = colliding()
    rng = np.random.default_rng(2)
    while True:  # a head whose hash is least, so that both texts are ordered by it
        head = rng.integers(65, 91, repeats.GRAM).astype(np.uint8)
        both = [np.r_[head, x] for x in (one, other)]
        grams = [repeats.Hashes(x)(np.arange(1025), np.arange(1025) + repeats.GRAM) for x in both]
        if all(g.argmin() == 0 for g in grams):
            break
    full = [repeats.Hashes(x)(np.array([0]), np.array([len(x)]))[0] for x in both]
    assert full[0] == full[1] and both[0].tobytes() != both[1].tobytes()
    rows = [(i, x.tobytes().decode()) for i, x in enumerate(both)]
    length = len(both[0])
    alone = repeats.digest(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert [r["n_removed"] for r in alone] == [0, 0]
    more = [*rows, (2, "x" + rows[0][1]), (3, rows[1][1] + "y")]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.digest(spark.createDataFrame(more, "doc_id long, text string"), length).collect()}
    assert got == dict.fromkeys(range(4), length)


def test_pieces_tell_by_content(spark):
    """Around one passage that many texts share, strings that differ in a byte stay."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = word(150)
    rows = [(i, word(60) + passage + word(60)) for i in range(40)]
    rows += [(100 + i, rows[i][1][:200] + "Z" + rows[i][1][201:]) for i in range(5)]
    texts = {i: t for i, t in rows}
    seen: dict[str, int] = {}
    for t in texts.values():
        for a in range(len(t) - 199):
            seen[t[a : a + 200]] = seen.get(t[a : a + 200], 0) + 1
    got = repeats.digest(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()
    for r in got:
        t = texts[r["doc_id"]]
        gone = {k for a in range(len(t) - 199) if seen[t[a : a + 200]] > 1 for k in range(a, a + 200)}
        assert r["n_removed"] == len(gone)
