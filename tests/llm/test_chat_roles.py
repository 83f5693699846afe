"""Participants whose rendered labels would be the same."""

from sieveline.llm import chat


def test_roles_with_one_label_are_different_participants(spark):
    rows = [(1, 0, "bob b", "a"), (1, 1, "bob_b", "b"), (1, 2, "李雷", "c"), (1, 3, "王芳", "d"), (1, 4, None, "e"), (1, 5, "unknown", "f"), (2, 0, "bob b", "g"), (None, 0, "x y", "h"), (None, 1, "x/y", "i")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns, 3).collect()
    assert len(got) == 6 * 6 + 1 + 2 * 2
    own = {}
    for r in got:
        if r.mask_start is not None:
            own.setdefault((r.conv_id, r.participant), []).append(r.segment)
        assert (r.mask_start is not None) == (r.speaker == r.participant)
    bodies = {k: [x.split("\n")[1].removesuffix("<|end|>") for x in v] for k, v in own.items()}
    coded = {name: f"{'_' * len(name) if name in ('李雷', '王芳') else name.replace(' ', '_').replace('/', '_')}~{name.encode().hex().upper()}" for name in ("bob b", "李雷", "王芳", "x y", "x/y")}
    want = {(1, coded["bob b"]): ["a"], (1, "bob_b"): ["b"], (1, coded["李雷"]): ["c"], (1, coded["王芳"]): ["d"], (1, "unknown~"): ["e"], (1, "unknown"): ["f"], (2, "bob_b"): ["g"], (None, coded["x y"]): ["h"], (None, coded["x/y"]): ["i"]}
    assert {k: sorted(v) for k, v in bodies.items()} == want
