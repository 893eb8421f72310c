import json

import pytest

from tidewright import catalog, cli, config

MINIMAL = {"databasePairs": [{"source": {"connectionString": "a", "database": "x"}, "target": {"connectionString": "b", "database": "y"}}]}


def test_defaults():
    c = config.parse(MINIMAL)
    assert c.saveThreshold == 100 and c.initialReadBatchSize == 8192 and c.incrementalWorkerCount >= 1
    assert c.parallelReadsEnabled is False and c.retry.enableBatchSplitting is False and c.retry.convertInvalidIds is True


def test_zero_counts_as_omitted_and_false_coercion_as_true():
    c = config.parse(MINIMAL | {"saveThreshold": 0, "sampleSize": -3, "retryConfig": {"maxRetries": 0, "convertInvalidIds": False}})
    assert c.saveThreshold == 100 and c.sampleSize == 1000 and c.retry.maxRetries == 5 and c.retry.convertInvalidIds is True


@pytest.mark.parametrize("path", [("source", "connectionString"), ("source", "database"), ("target", "connectionString"), ("target", "database")])
def test_required_fields(path):
    raw = json.loads(json.dumps(MINIMAL))
    raw["databasePairs"][0][path[0]][path[1]] = ""
    with pytest.raises(config.ConfigError):
        config.parse(raw)


def test_mappings_need_both_names():
    raw = json.loads(json.dumps(MINIMAL))
    raw["databasePairs"][0]["target"]["collections"] = [{"sourceCollection": "a"}]
    with pytest.raises(config.ConfigError):
        config.parse(raw)
    raw["databasePairs"][0]["target"]["collections"] = [{"sourceCollection": "a", "targetCollection": "b", "upsertMode": True}]
    pair = config.parse(raw).pairs[0]
    assert pair.collections == (config.Mapping("a", "b", True),)
    assert catalog.target_name(pair, "a") == "b" and catalog.target_name(pair, "other") == "other"
    assert catalog.selected(pair, ["z"]) == [config.Mapping("a", "b", True)]
    assert catalog.selected(config.parse(MINIMAL).pairs[0], ["z"]) == [config.Mapping("z", "z")]


def test_empty_pairs_and_broken_files(tmp_path):
    with pytest.raises(config.ConfigError):
        config.parse({})
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.json"))
    assert cli.main(["-config", str(tmp_path / "c.json")]) == 2
    assert cli.main(["-config", str(tmp_path / "absent.json")]) == 2


def test_unknown_log_level_is_info():
    import logging

    assert cli.set_level("loud") == logging.INFO and cli.set_level("DEBUG") == logging.DEBUG


def test_index_options(spark):
    rows = [("c", "n", [("b", "1"), ("a", "-1")], True, False, 2**31, None, None, None, None, None)]
    row = catalog.index_options(spark.createDataFrame(rows, catalog.INDEX_SCHEMA)).first()
    assert [k.field for k in row["keys"]] == ["b", "a"] and row["unique"] is True and row["sparse"] is None and row["expire_after_seconds"] is None
