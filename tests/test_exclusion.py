"""Exclusion that would drop most of a text is switched off."""

from folioscope.operators import chunking


def test_an_early_references_line_does_not_drop_the_body():
    body = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(100)) + "." for i in range(60))
    told = lambda line: (line, "hard", line) if line == "References" else (line, "none", "")
    packed = lambda t: " ".join(c["body"] for c in chunking.pack([told(x) for x in t.split("\n")], chunking.words, chunking.Sizes()))
    assert "word59x99" in packed(f"Contents\n\nReferences\n{body}")
    short = packed(f"{body}\n\nReferences\n\nsome entry")
    assert "word59x99" in short and "entry" not in short
    count = chunking.words
    part = lambda *p: [(i, t, "w " * n) for i, (t, n) in enumerate(p)]
    assert chunking.keeps_excluded(part(("References", 1000)), count) and not chunking.keeps_excluded(part(("References", 999)), count)
    assert chunking.keeps_excluded(part(("Methods", 2000), ("References", 10000)), count) and not chunking.keeps_excluded(part(("Methods", 2001), ("References", 10000)), count)
    assert chunking.keeps_excluded(part(("Methods", 2000), ("References", 3000), ("Bibliography", 3000)), count)
    assert not chunking.keeps_excluded(part(("Methods", 2000), ("References", 6000)), count)
