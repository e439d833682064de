import os

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.embedding import TrigramEmbedder
from glyphmill.functions.tokens import CharCounter
from glyphmill.operators.inference import FunctionProvider, IdentityProvider
from glyphmill.plans import jobs, profiles
from glyphmill.plans.profiles import SINGLE_FILE, TWO_FILES, ProfileError, from_config, load_profile
from glyphmill.plans.translation import Translation, register_strategy, to_single_file, to_two_files, translate

METHODS = "".join(f"    public int M{i}(int a)\n    {{\n        return a + {i};\n    }}\n\n" for i in range(12))
LONG = "using System;\n\npublic class Long\n{\n    int x;\n" + METHODS + "}\n"


def config(**target):
    return {
        "prompts": {"system": "S", "full": "full", "class_only": "class_only", "methods_only": "methods_only"},
        "llm": {"class": "TrivialLLM"},
        "source": {"csharp": {"convert_macros_to_comments": True}},
        "target": {"convert_tabs_to_spaces": True, "extension": ".gd", **target},
        "strategies": {".cs": SINGLE_FILE},
    }


def job(conf, provider, limit=None):
    profile = from_config({**conf, "llm": {"class": "x", "config": {"max_tokens": limit}}})
    return Translation(profile, "/src", "/out", provider=provider)


def sources(spark, *rows):
    return spark.createDataFrame([(*r, None)[:3] for r in rows], "path string, text string, error string")


def translated(user, system, history):
    return f"DONE {user}"


def test_small_and_large_files_in_one_go(spark):
    df = sources(spark, ("/src/a/Small.cs", "class A { }"), ("/src/a/Long.cs", LONG), ("/src/Bad.cs", None, "file is empty"))
    rows = {r["path"]: r for r in to_single_file(df, job(config(), FunctionProvider(translated), 300)).collect()}
    assert rows["/src/a/Small.cs"]["content"] == "DONE full"
    assert rows["/src/a/Small.cs"]["dest_path"] == "/out/a/Small.gd"
    batches = rows["/src/a/Long.cs"]["content"].split("\n\n")
    assert batches[0] == "DONE class_only"
    # Twelve methods of about 60 characters, four to a batch.
    assert batches[1:] == ["DONE methods_only"] * 3
    assert rows["/src/Bad.cs"]["status"] == "failed" and rows["/src/Bad.cs"]["error"] == "file is empty"
    assert rows["/src/Bad.cs"]["content"] is None


def test_methods_go_where_the_skeleton_wants_them(spark):
    conf = config(convert_tabs_to_spaces=False, convert_spaces_to_tabs=True)
    conf["prompts"].update(full="${CODE}", class_only="```\nclass\n    ${METHODS}\nend\n```", methods_only="```\nM\n```")
    out = to_single_file(sources(spark, ("/src/L.cs", LONG)), job(conf, IdentityProvider(), 300)).first()
    assert out["content"] == "class\n\t" + "\n\nM" * 3 + "\nend"


def test_one_failing_piece_fails_the_file_only(spark):
    def refuse(user, system, history):
        if "M5" in user:
            raise ValueError("too hard")
        return user

    conf = config()
    conf["prompts"].update(full="${CODE}", class_only="${CODE}", methods_only="${CODE}")
    df = sources(spark, ("/src/Long.cs", LONG), ("/src/B.cs", "class B { }"))
    rows = {r["path"]: r for r in to_single_file(df, job(conf, FunctionProvider(refuse), 300)).collect()}
    assert (rows["/src/Long.cs"]["status"], rows["/src/Long.cs"]["error"]) == ("failed", "query failed: too hard")
    assert rows["/src/Long.cs"]["content"] is None
    assert rows["/src/B.cs"]["status"] == "ok"


def test_a_missing_prompt_fails_only_files_that_need_it(spark):
    conf = config()
    del conf["prompts"]["class_only"]
    df = sources(spark, ("/src/Long.cs", LONG), ("/src/B.cs", "class B { }"))
    rows = {r["path"]: r for r in to_single_file(df, job(conf, FunctionProvider(translated), 300)).collect()}
    assert rows["/src/Long.cs"]["error"] == "prompt 'class_only' is not defined"
    assert rows["/src/B.cs"]["status"] == "ok"


def test_two_files(spark):
    conf = config(header_extension=".h", implementation_extension=".cpp", convert_filename_to_camelcase=True)
    conf["prompts"].update(
        full="```\nH\n```\n```\nI\n```", class_only="```\nclass ${METHODS} end\n```\n```\nimpl ${METHODS}\n```",
        methods_only="```\nmh\n```\n```\nmi\n```",
    )
    df = sources(spark, ("/src/my_small.cs", "class A { }"), ("/src/my_long.cs", LONG), ("/src/x.cs", None, "bad"))
    rows = {r["dest_path"]: r for r in to_two_files(df, job(conf, IdentityProvider(), 300)).collect()}
    assert rows["/out/mySmall.h"]["content"] == "H" and rows["/out/mySmall.cpp"]["content"] == "I"
    assert rows["/out/myLong.h"]["content"] == "class " + "\n\nmh" * 3 + " end"
    assert rows["/out/myLong.cpp"]["content"] == "impl ${METHODS}\n\n" + "\n\nmi" * 3
    assert rows["/out/x.h"]["status"] == "failed" and len(rows) == 5


def test_strategies_by_name(spark):
    conf = config(header_extension=".h", implementation_extension=".cpp")
    conf["strategies"] = {".cs": SINGLE_FILE, ".hx": TWO_FILES, ".zz": "Unknown", ".my": "Mine"}
    register_strategy("Mine", lambda df, j: df.select(
        "path", F.lit("ok").alias("status"), "error", F.lit("mine").alias("dest_path"), F.col("text").alias("content")))
    rows = [("/src/a.cs", "a", None, SINGLE_FILE), ("/src/b.hx", "b", None, TWO_FILES),
            ("/src/c.zz", "c", None, "Unknown"), ("/src/d.my", "d", None, "Mine")]
    df = spark.createDataFrame(rows, "path string, text string, error string, strategy string")
    got = {(r["path"], r["dest_path"]): r for r in translate(df, job(conf, IdentityProvider())).collect()}
    assert {k[1] for k in got} == {"/out/a.gd", "/out/b.h", "/out/b.cpp", None, "mine"}
    assert got[("/src/c.zz", None)]["error"] == "strategy 'Unknown' is not known"


def project(root, extra=None):
    names = {
        "ProjectSettings/x.asset": b"",
        "Assets/Code/FooBar.cs": b"class FooBar { }",
        "Assets/Code/foo_bar.cs": b"class foo_bar { }",
        "Assets/Code/Empty.cs": b"",
        "Assets/Code/Bad.cs": b"\xff\xfe",
        "Assets/Code/Long.cs": LONG.encode(),
        "Assets/Code/notes.txt": b"text",
        "Library/Gone.cs": b"class Gone { }",
        **(extra or {}),
    }
    for name, content in names.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


def echo_code(user, system, history):
    return f"{len(history)}\n{user}"


def test_a_whole_migration(spark, tmp_path):
    source, dest = str(tmp_path / "src"), str(tmp_path / "out")
    project(source)
    report = jobs.run(
        spark, "godot", source, dest, provider=FunctionProvider(echo_code), counter=CharCounter(), embedder=TrigramEmbedder(),
    )
    rows = {os.path.relpath(r["path"], source): r for r in report.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "Assets/Code/FooBar.cs": "ok", "Assets/Code/foo_bar.cs": "skipped", "Assets/Code/Empty.cs": "failed",
        "Assets/Code/Bad.cs": "failed", "Assets/Code/Long.cs": "ok",
    }
    assert rows["Assets/Code/Long.cs"]["dest_path"] == dest + "/assets/code/long.gd"
    assert sorted(os.listdir(dest + "/assets/code")) == ["foo_bar.gd", "long.gd"]
    text = open(dest + "/assets/code/foo_bar.gd").read()
    assert text.startswith("10\nMigrate this Unity C# code to GDScript class.") and "class FooBar" in text


def test_two_file_migration_reports_once_per_source(spark, tmp_path):
    source, dest = str(tmp_path / "src"), str(tmp_path / "out")
    project(source)
    report = jobs.run(spark, "unreal", source, dest, provider=IdentityProvider(), counter=CharCounter())
    rows = {os.path.relpath(r["path"], source): r for r in report.collect()}
    assert len(rows) == 5
    assert rows["Assets/Code/foo_bar.cs"]["status"] == "ok"
    assert sorted(os.listdir(dest + "/Assets/Code")) == ["FooBar.cpp", "FooBar.h", "Long.cpp", "Long.h", "fooBar.cpp", "fooBar.h"]
    assert rows["Assets/Code/Long.cs"]["dest_path"].endswith("Long.h")


def test_exit_codes(spark, tmp_path):
    source, dest = str(tmp_path / "src"), str(tmp_path / "out")
    project(source)
    how = dict(provider=IdentityProvider(), counter=CharCounter())
    assert jobs.run_to_exit_code(spark, "nowhere", source, dest) == 78
    assert jobs.run_to_exit_code(spark, "godot-mono", source + "/none", dest) == 78
    assert jobs.run_to_exit_code(spark, "godot-mono", source, source + "/Assets/Code/FooBar.cs/x") == 74
    assert jobs.run_to_exit_code(spark, "godot-mono", source + "/Assets", dest) == 70
    assert jobs.run_to_exit_code(spark, "godot-mono", source, dest, **how) == 0


def test_profiles(tmp_path):
    assert set(profiles.PROFILES) == {"godot", "godot-huggingface", "godot-mono", "unreal"}
    godot = load_profile("godot")
    assert (godot.limit, godot.extension, godot.known.count, godot.snake_case_names) == (10000, ".gd", 5, True)
    assert load_profile("godot-huggingface").limit == 4096
    assert load_profile("unreal").known is None and load_profile("unreal").camel_case_names
    path = tmp_path / "own.yaml"
    path.write_text("llm:\n  class: MultiprocessLocalLLM\n  llm_config:\n    class: TrivialLLM\n    config:\n  wrapper_config:\n    num_workers: 5\n    query_timeout_sec: 10\n")
    own = load_profile(str(path))
    provider = jobs.provider_for(own)
    assert (own.provider, own.limit, provider.threads, provider.timeout_sec) == ("TrivialLLM", None, 5, 10)
    with pytest.raises(ProfileError, match="godot-mono"):
        load_profile("nope")
    with pytest.raises(ProfileError, match="llm"):
        from_config({"prompts": {}})


def test_a_project_without_sources_and_a_rerun(spark, tmp_path):
    source, dest = str(tmp_path / "src"), str(tmp_path / "out")
    for name in ("Assets/readme.txt", "ProjectSettings/x.asset"):
        os.makedirs(os.path.dirname(f"{source}/{name}"), exist_ok=True)
        open(f"{source}/{name}", "w").close()
    how = dict(provider=IdentityProvider(), counter=CharCounter())
    assert jobs.run(spark, "godot-mono", source + "/", dest + "/", **how).count() == 0
    project(source)
    for _ in range(2):  # a second run overwrites the first
        report = jobs.run(spark, "godot-mono", source + "/", dest + "/", **how, reply_store=str(tmp_path / "replies"))
        assert report.filter("status = 'ok'").count() == 3
        assert sorted(os.listdir(dest + "/assets/code")) == ["FooBar.cs", "Long.cs", "foo_bar.cs"]


def test_scratch_is_removed_but_for_what_is_kept(spark):
    import os

    from glyphmill.scratch import cleaned, materialize

    with cleaned(spark) as keep:
        one = materialize(spark.range(3), "one")
        at = one.inputFiles()[0]
        kept = keep(one.selectExpr("id + 1 as id"))
    assert kept.count() == 3 and not os.path.exists(at.removeprefix("file://"))


def test_a_template_makes_one_flat_prompt_and_extractors_can_be_given(spark):
    conf = config()
    conf["prompts"].update(system="Be brief.", full="${CODE}")
    profile = from_config({**conf, "llm": {"class": "x", "config": {"prompt_template": "[I]${PROMPT}[/I]"}}})
    flat = Translation(profile, "/src", "/out", provider=FunctionProvider(lambda user, system, history: f"{system}|{len(history)}|{user}"))
    df = sources(spark, ("/src/B.cs", "class B { }"))
    got = to_single_file(df, flat, extract=lambda reply: F.upper(reply)).first()["content"]
    assert got.startswith("NONE|0|[I]") and "BE BRIEF." in got and got.endswith("[I]\nCLASS B { }\n\n[/I]")


def test_known_pairs_need_a_count():
    with pytest.raises(ProfileError):
        from_config({**config(), "known_translations": {"target_engine": "godot"}})


def test_several_strategies_read_and_ask_once(spark):
    from glyphmill.plans.profiles import SINGLE_FILE, TWO_FILES, Profile
    from glyphmill.plans.translation import Translation, translate

    profile = Profile(
        prompts={"full": "// A.h\n${CODE}\n// A.cpp\n// body"}, provider=None, extension=".gd", header_extension=".h", implementation_extension=".cpp",
        strategies={".cs": SINGLE_FILE, ".txt": TWO_FILES, ".x": "Nobody"},
    )
    rows = [("/s/a.cs", "one", SINGLE_FILE), ("/s/b.txt", "two", TWO_FILES), ("/s/c.x", "three", "Nobody")]
    made = translate(spark.createDataFrame(rows, "path string, text string, strategy string"), Translation(profile, "/s", "/out"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {r.dest_path or r.path: (r.status, r.error, r.content) for r in made.collect()}
    assert got["/out/b.h"] == ("ok", None, "two") and got["/out/b.cpp"] == ("ok", None, "// body")
    assert got["/out/a.gd"][0] == "ok" and got["/s/c.x"] == ("failed", "strategy 'Nobody' is not known", None) and len(got) == 4


def test_run_refuses_a_source_that_is_no_folder(spark, tmp_path):
    from glyphmill.plans import jobs

    with pytest.raises(NotADirectoryError):
        jobs.run(spark, "godot", str(tmp_path / "none"), str(tmp_path / "out"))


def test_neither_names_nor_contents_pass_the_driver_in_joins(spark, tmp_path, monkeypatch):
    """Small estimates, of tables that pack well or of contents read by name, don't make the driver collect and send them."""
    from glyphmill import scratch
    from glyphmill.catalog import QUERIES

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    docs = [(i, f"text {i}" + "." * i, "en", "web", 6 + i) for i in range(40)]
    said = [(1, 0, "user", "Why?"), (1, 1, "assistant", "So."), (2, 0, "user", "How?"), (2, 1, "assistant", "Thus.")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plans, write = {}, scratch.materialize

    def watched(df, label):
        plans[label] = plan(df)
        return write(df, label)

    for place in (jobs, scratch):
        monkeypatch.setattr(place, "materialize", watched)
    out = QUERIES["migrate_project"](spark, str(tmp_path))
    plans["result"] = plan(out)
    for label in ("files", "kept", "result"):
        assert "Join" in plans[label] and "Broadcast" not in plans[label], label
    rows = {r.path: r for r in out.collect()}
    taken = [i for i in range(40) if i % 7 and i % 11]
    assert len(rows) == len(taken) and rows["Assets/foo_bar3.cs"].status == "skipped"  # FooBar3.cs comes before
    for i in taken:
        r = rows[f"Assets/{('FooBar' if i % 10 == 0 else 'foo_bar') + str(i // 10) if i % 10 < 2 else f'Doc{i}'}.cs"]
        if r.status != "skipped":
            good = i % 13 and len(docs[i][1]) % 5
            assert (r.status, r.content) == (("ok", f"// Answer with code only.\n{docs[i][1]}\n// 4") if good else ("failed", None))
