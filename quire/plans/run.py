"""Running plans: an external tool in the task that holds the file."""

from __future__ import annotations

import ctypes
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame

#: How often a tool that cannot be started is tried.
STARTS = 2
RESULT = "file_id string, content binary, error string"


def _end_with_parent() -> None:
    """Has the system stop the tool when the task's process ends, as it does when the task is cancelled."""
    die_with_parent, kill = 1, 9  # PR_SET_PDEATHSIG, SIGKILL
    ctypes.CDLL(None).prctl(die_with_parent, kill)


def _started(command: list[str], folder: str, timeout: int) -> int | None:
    """The tool's exit code; None if it could not be started, -1 if it took too long and was stopped."""
    for _ in range(STARTS):
        try:
            return subprocess.run(command, cwd=folder, capture_output=True, timeout=timeout, preexec_fn=_end_with_parent).returncode  # noqa: PLW1509
        except subprocess.TimeoutExpired:
            return -1
        except OSError:
            continue
    return None


def cores_a_task(cores: int) -> ResourceProfile | None:
    """The profile of tasks that hold so many cores, so that a tool of several threads has them; None for one core."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build if cores > 1 else None


def run_plans(plans: DataFrame, tool: str, timeout: int = 3600, cores: int = 1) -> DataFrame:
    """file_id, content and error from plans (file_id, argv, input_name, output_name, content).

    cores is how many threads the tool uses: the stage that runs it gets tasks of so many
    cores (on a cluster; a single machine deals out single cores only), other stages keep theirs.
    A column argv_again, if there is one, is a second plan for a file that the first fails on.
    Each row runs in a scratch folder of its task, which is gone afterwards, and ends with its
    task. Errors: TOOL_MISSING if the tool is missing or cannot be started, also when tried
    again, DECODE_FAILED if it fails or writes nothing.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        program = shutil.which(tool)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                content, error = None, None
                if program is None:
                    error = "TOOL_MISSING"
                else:
                    with tempfile.TemporaryDirectory() as folder:
                        with open(os.path.join(folder, row["input_name"]), "wb") as f:
                            f.write(row["content"] or b"")
                        target = os.path.join(folder, row["output_name"])
                        for own in [row["argv"], row.get("argv_again")]:
                            if own is None or content:
                                break
                            code = _started([program, *own], folder, timeout)
                            if code == 0 and os.path.exists(target) and os.path.getsize(target):
                                with open(target, "rb") as f:
                                    content = f.read()
                    error = None if content else "TOOL_MISSING" if code is None else "DECODE_FAILED"
                rows.append((row["file_id"], content, error))
            names = ["file_id", "content", "error"]
            kinds = [pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    again = ["argv_again"] if "argv_again" in plans.columns else []
    return plans.select("file_id", "argv", *again, "input_name", "output_name", "content").mapInArrow(run, RESULT, profile=cores_a_task(cores))
