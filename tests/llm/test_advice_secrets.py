"""Secrets: one feature of a run hides nothing else in it."""

from doclens.llm import secrets_entropy

KEY, OTHER = "q8Zr2LxWv7Kd0NcYb5TgJ1mPfHs9AeUoR4iD6kEw", "Zt6Rw1QpLx8Vb3NmKc5Hj0FgDs7AyUeI2oPzXq4T"


def test_runs_are_cut(frame):
    texts = [
        f"/v1/{'0123abcd' * 4}/{KEY}", f"/sample/files/{KEY}", f"{KEY}/example/{OTHER}", f"{KEY}{'a' * 90}{OTHER}", "see qZrLxWvKdNcYbTgJmPfHsAeU",
        f"EXAMPLE{KEY}", f"{'ab' * 20}", "this-is-only-a-line-of-lower-case-words",
    ]
    got = {r.doc_id: [x for x in r.secrets] for r in secrets_entropy.find_secrets(frame(texts)).collect()}
    entropic = lambda k: [x for x in got[k] if x.kind == "entropy_base64"]
    covers = lambda k, key: any(x.start <= texts[k].index(key) + 4 and x.end >= texts[k].index(key) + len(key) - 4 for x in entropic(k))
    assert [x.kind for x in got[0]] == ["hex", "entropy_base64"] and covers(0, KEY)
    assert covers(1, KEY) and covers(2, KEY) and covers(2, OTHER)
    assert len(entropic(3)) == 2 and covers(3, KEY) and covers(3, OTHER)
    assert covers(4, "qZrLxWvKdNcYbTgJmPfHsAeU")
    assert not any(entropic(k) for k in (5, 6, 7))
