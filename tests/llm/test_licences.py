import brute

from moundworks.llm import licences


def test_base_places(docs, odd, none):
    for rows in (docs, odd):
        found = licences.licences(rows).collect()
        want = sorted(repr((r.doc_id, *brute.base_licences(r.text))) for r in rows.collect())
        assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in found)
    assert licences.licences(none).count() == 0


def test_templates_are_found_in_pieces(spark):
    (_, mit), (_, bsd) = licences.TEMPLATES[1], next(t for t in licences.TEMPLATES if t[0] == "bsd")
    words = mit.split()
    broken = "Prose before. " + " ".join(words[:60]).upper() + " [snip] " + " ".join(words[62:]) + " prose after"
    rows = [(1, broken), (2, bsd), (3, " ".join(words[:20])), (4, "the software of the and to use"), (5, "Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i].labels for i in range(1, 6)] == ["mit", "bsd", "", "", "cc-by-nc"]
    assert found[1].spans[0].first == 2 and found[1].score > 0.95 and found[2].score == 1.0 and found[4].score < 0.2


def test_statistics_against_plain_search():
    sequences = [[1, 2, 3, 1, 2, 4], [2, 3, 1, 5], [1, 2, 3]]
    automaton = licences.SuffixAutomaton(sequences)
    passages = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [1, 2, 3, 1, 5, 9, 2, 3, 1, 2, 4, 4, 1]
    for end, (state, length) in enumerate(automaton.statistics(text), 1):
        want = max((n for n in range(end + 1) if n == 0 or tuple(text[end - n:end]) in passages), default=0)
        assert length == want
        if length:
            passage = text[end - length:end]
            places = {(t, j) for t, s in enumerate(sequences) for j in range(length, len(s) + 1) if s[j - length:j] == passage}
            assert automaton.ends(state) == sorted(places)


def test_occurrences_are_kept_once_whatever_repeats():
    sequences = [[1] * 400, [1, 2] * 300]
    automaton = licences.SuffixAutomaton(sequences)
    assert len(automaton._places) == 1000
    state, length = automaton.statistics([1] * 5)[-1]
    assert length == 5 and automaton.ends(state) == [(0, i) for i in range(5, 401)]
