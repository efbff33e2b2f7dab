"""Settings, prompts and the weakness catalogue."""

import json
import zipfile

import pytest

from prospector.sources import settings


def test_variables_and_endpoint(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nexport OPENAI_MODEL = 'm'\nOPENAI_BASE_URL=https://f\nOPENAI_API_KEY=\"fk\"\nbroken\n=x\n")
    assert settings.variables(env.read_text()) == {"OPENAI_MODEL": "m", "OPENAI_BASE_URL": "https://f", "OPENAI_API_KEY": "fk"}
    got = settings.endpoint({"OPENAI_BASE_URL": "https://s", "X": "1"}, str(env))
    assert (got["OPENAI_BASE_URL"], got["OPENAI_API_KEY"], got["X"]) == ("https://f", "fk", "1")
    assert settings.endpoint({"OPENAI_BASE_URL": "https://s", "OPENAI_API_KEY": "sk"}, str(env))["OPENAI_API_KEY"] == "sk"
    env.write_text("OPENAI_API_KEY=fk\n")
    with pytest.raises(settings.SettingsError):
        settings.endpoint({"OPENAI_BASE_URL": "https://s"}, str(env))
    service = settings.Service.of({"OPENAI_MODEL": " m ", "OPENAI_API_KEY": "secret", "OPENAI_MAX_RETRIES": "2"})
    assert (service.model, service.max_retries) == ("m", 2) and "secret" not in repr(service)
    for bad in ({}, {"OPENAI_MODEL": "m", "OPENAI_API_KEY": "k", "OPENAI_TIMEOUT_S": "x"}, {"OPENAI_MODEL": "m", "OPENAI_API_KEY": "k", "OPENAI_TIMEOUT_S": "0"}):
        with pytest.raises(settings.SettingsError):
            settings.Service.of(bad)


def test_prompts_and_views(spark, tmp_path):
    assert settings.prompt_manifest("A0", str(tmp_path), {"id": "own"}) == {"id": "own"}
    (tmp_path / "a1-v1.json").write_text(json.dumps({"profile": "A1", "id": "i", "system_prompt": "s"}))
    assert settings.prompt_manifest("A1", str(tmp_path), {})["id"] == "i"
    (tmp_path / "a0-v1.json").write_text(json.dumps({"profile": "A1", "id": "i", "system_prompt": "s"}))
    for profile in ("A0", "B"):
        with pytest.raises(ValueError):
            settings.prompt_manifest(profile, str(tmp_path), {})
    df = spark.createDataFrame([("r", "c", "x", "secret")], "repo string, sha string, issue_refs string, verdict string")
    assert settings.candidate_view(df, "A0").columns == ["repo", "sha"] and df.select(settings.candidate_json(df, "A1")).first()[0] == '{"issue_refs":"x","repo":"r","sha":"c"}'
    assert settings.file_hash(None, "v1") != settings.file_hash(str(tmp_path / "a1-v1.json"), "v1") and settings.table_manifests()["keyword_count"] > 40
    with pytest.raises(FileNotFoundError):
        settings.resource(str(tmp_path), "none")


def test_catalogue(spark, tmp_path):
    xml = """<?xml version="1.0"?><Weakness_Catalog xmlns="http://x"><Weaknesses>
<Weakness ID="79" Name="XSS" Abstraction="Base" Status="Stable"><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="707"/><Related_Weakness Nature="ChildOf" CWE_ID="74"/><Related_Weakness Nature="PeerOf" CWE_ID="1"/><Related_Weakness Nature="ChildOf" CWE_ID="74"/></Related_Weaknesses></Weakness>
<Weakness ID="9" Name="Nine" Abstraction="Class" Status="Draft"></Weakness></Weaknesses></Weakness_Catalog>"""
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("cwec.xml", xml)
    rows = settings.weakness_catalogue(spark, str(tmp_path / "c.zip"), str(tmp_path / "w")).collect()
    assert [(r["id"], r["name"], r["status"], list(r["parents"])) for r in rows] == [("CWE-9", "Nine", "Draft", []), ("CWE-79", "XSS", "Stable", ["CWE-74", "CWE-707"])]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(ValueError, match="one XML"):
        settings.weakness_catalogue(spark, str(tmp_path / "d.zip"), str(tmp_path / "w"))
