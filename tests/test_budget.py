"""Further tries that end in an answer don't use up what a partition has."""

from __future__ import annotations

from corvane.operators import generation


def failing_once():
    """Connects to a service that fails each prompt once."""

    def connect():
        seen: set[str] = set()

        def client(prompt: str) -> str:
            if prompt not in seen:
                seen.add(prompt)
                raise generation.Retry("busy")
            return '{"rewrites": []}'

        return client

    return connect


def test_many_tasks_that_fail_once_all_get_answers(spark):
    tasks = spark.createDataFrame([(k, f"p{k}") for k in range(60)], "id long, prompt string")
    out = generation.generate(tasks, "id", "prompt", failing_once(), concurrency=1, in_flight=2, retries=5, base=0.0001).collect()
    assert len(out) == 60 and all(r.error is None for r in out)
