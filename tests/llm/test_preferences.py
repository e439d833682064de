from glyphmill.llm import preferences, queries

SCHEMA = "pair_id long, turn long, role string, text string, extra int"


def test_prompt_is_shared_and_completions_are_masked(spark):
    shared = [(7, 0, "system", "be brief", 1), (7, 1, "user", "why?", 2)]
    chosen = spark.createDataFrame(shared + [(7, 2, "assistant", "so", 3), (7, 3, "user", "ok", 4), (7, 4, "assistant", "fine", 5), (8, 0, "user", "only", 6)], SCHEMA)
    rejected = spark.createDataFrame(shared + [(7, 2, "assistant", "no", 9), (9, 0, None, None, 0)], SCHEMA)
    got = {r.pair_id: r for r in preferences.examples(chosen, rejected).collect()}
    r = got[7]
    assert (r.n_prompt_turns, r.prompt) == (2, "<|system|>\nbe brief<|end|>\n<|user|>\nwhy?<|end|>\n")
    assert r.rejected == "<|assistant|>\nno<|end|>\n" and r.chosen.startswith("<|assistant|>\nso<|end|>\n<|user|>\nok<|end|>\n")
    cut = lambda text, spans: [text[s.start : s.start + s.length] for s in spans]
    assert cut(r.chosen, r.chosen_spans) == ["so<|end|>\n", "fine<|end|>\n"] and cut(r.rejected, r.rejected_spans) == ["no<|end|>\n"]
    assert (got[8].prompt, got[8].rejected, got[8].chosen_spans) == ("", "", []) and got[8].chosen == "<|user|>\nonly<|end|>\n"
    assert got[9].rejected == "<|>\n<|end|>\n".replace("<|>", "<||>") and got[9].chosen == ""
    same = preferences.examples(chosen, chosen).collect()
    assert all(r.chosen == r.rejected == "" and r.n_prompt_turns for r in same)
    assert preferences.examples(chosen.limit(0), rejected.limit(0)).count() == 0


def test_native(spark):
    plan = queries.op8_preferences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
