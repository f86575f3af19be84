"""License mentions of hand-made texts."""

from llm_fixtures import slides  # noqa: F401

from deckloom.llm.licences import TEMPLATES, license_scan


def test_texts(slides):
    apache, mit = TEMPLATES[0][1], next(t for label, t in TEMPLATES if t.startswith("Permission is hereby"))
    words = mit.split()
    edited = " ".join(words[:9] + ["well"] + words[9:])  # one word more: the rest lies on the next diagonal
    rows = [
        (1, "Under the Apache License, and the MIT-License; apache license"), (2, f"Intro words. {apache} The end."), (3, f"Note: {edited}"),
        (4, "free of charge to any person who came"), (5, None), (6, ""), (7, "MIT LICENSE MIT LICENSE"),
        (8, "Licensed under CC BY-NC 4.0."), (9, " ".join([apache] * 40)), (None, "mit license"), (1, "mit license"), (1, "mit license"),
        (11, "caf\u00e9 licen\u00e7a mit\u00e9 license"), (12, "submit license, gnu general public license"), (13, "w " * 50_000 + "cc by")]
    found = license_scan(slides(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.slide_id: r for r in found if r.slide_id not in (1, None)}
    short = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
    assert sorted(short(r) for r in found if r.slide_id == 1) == [
        (2, 1, 0, 0, "mit", "mit"), (2, 1, 0, 0, "mit", "mit"), (10, 3, 2, 8, "apache,mit", "apache,mit")]
    assert by_id[2].base_labels == "apache" and by_id[2].score == 1.0
    assert short(by_id[3])[1:] == (0, None, None, "", "mit") and 0.9 < by_id[3].score <= 1.0
    assert short(by_id[4])[1:] == (0, None, None, "", "") and by_id[4].score == 0.0
    assert short(by_id[5]) == short(by_id[6]) == (0, 0, None, None, "", "")
    assert short(by_id[7]) == (4, 2, 0, 2, "mit", "mit")
    assert by_id[8].labels == "cc-by,cc-by-nc"
    assert by_id[9].labels == "apache" and by_id[9].n_base == 40
    assert short(by_id[11]) == (4, 0, None, None, "", "")
    assert short(by_id[12]) == (6, 1, 2, 2, "gpl", "gpl")
    assert short(by_id[13]) == (50_002, 1, 50_000, 50_000, "cc-by", "cc-by")
    assert license_scan(slides([])).collect() == []
