"""What a Python worker keeps for its next tasks."""

import gc
import weakref

import pyarrow as pa

from sedge.llm import work


class Large:
    pass


def test_forgotten_by_other_tasks():
    """A task that asks for what an earlier one kept gets the same; one that doesn't lets go of it."""
    first = work.begun(lambda: work.kept_in_process("large", Large))
    gone = weakref.ref(first)
    assert work.begun(lambda: work.kept_in_process("large", Large)) is first
    del first
    assert gone() is not None
    work.begun(lambda: None)
    gc.collect()
    assert gone() is None


def test_task_of_another_stage(spark):
    """In one worker: tasks of a stage that keeps something, then one of a stage that doesn't."""
    ask, held, mapped, fields = work.kept_in_process, work._kept, work.mapped, work.fields

    def keeper():
        kept = ask("large", lambda: bytearray(8))
        return lambda batch: {"same": [kept is ask("large", None)] * batch.num_rows}

    def other():
        return lambda batch: {"there": ["large" in held()] * batch.num_rows}

    rows = spark.range(0, 8, 1, 1)
    for _ in range(2):
        assert {r.same for r in mapped(rows, keeper, fields(same="boolean")).collect()} == {True}
    assert {r.there for r in mapped(rows, other, fields(there="boolean")).collect()} == {False}
