"""The stream with state against the totals of a table, over changes, removals, late versions, repeated rows and a restart."""

import pytest

from scanloom.streaming.skill_states import ADDED, follow, skill_totals

FILES = "skill_id string, file_ord long, rel_path string, content string"
BATCHES = [
    [("s", 1, "a.ts", "eval(x)\nconsole.log(1)"), ("s", 2, "b.ts", 'const password = "pa55w0rd"'), ("t", 3, "yarn.lock", "x"), (None, 4, "c.ts", "eval(x)"), ("t", None, "c.ts", "eval(x)")],
    [("s", 5, "a.ts", "fine"), ("u", 6, ".gitignore", ".env"), ("t", 7, None, "eval(x)")],
    [("s", 4, "a.ts", "eval(late)"), ("s", 8, "b.ts", None), ("t", 9, "d.py", "logger.error(x)\npickle.loads(y)"), ("t", 9, "d.py", "logger.error(x)\npickle.loads(y)")],
    [("s", 6, "b.ts", "eval(x) eval(y)"), ("u", 10, ".gitignore", None), ("s", 11, "e.ts", "eval(z)")],
]


def plain(rows):
    return {r["skill_id"]: tuple(r[c] for c in (*ADDED, "security")) for r in rows}


@pytest.mark.parametrize("restarts", [False, True])
def test_end_state_equals_the_table(spark, tmp_path, restarts):
    folder, seen = tmp_path / "in", {}

    def sink(totals, number):
        seen.update(plain(totals.collect()))

    def run():
        rows = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(folder))
        follow(rows, sink, str(tmp_path / "state")).awaitTermination()

    for k, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, FILES).coalesce(1).write.mode("append").parquet(str(folder))
        if restarts or k == len(BATCHES) - 1:
            run()
    table = spark.createDataFrame([r for b in BATCHES for r in b], FILES)
    want = plain(skill_totals(table).collect())
    assert seen == want and set(want) == {"s", "t", "u"}
    at = dict(zip((*ADDED, "security"), want["s"]))
    assert (at["files"], at["critical"], at["code_files"]) == (2, 1, 2) and want["u"] == (*[0] * len(ADDED), 100)


def test_empty_table(spark):
    assert skill_totals(spark.createDataFrame([], FILES)).count() == 0
