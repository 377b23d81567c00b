"""One budget of calls for all tasks, bounded calls, and calls that hang."""

import os
import subprocess
import sys
import time

from heronkb.config import Hooks
from heronkb.sources import hooks


def test_all_tasks_together_stay_under_the_limit(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as out:
            out.write(f"{time.time()} {len(texts)}\n")
        if texts[0].endswith("7"):
            raise ValueError("no")
        return [x.upper() for x in texts]

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id int, text string").repartition(9)
    limit, callers = 8.0, 4
    out = hooks.rewritten(rows, "text", "answer", Hooks(rewrite=model, calls_per_second=limit, callers=callers, texts_per_call=2, attempts=2, retry_wait_s=0.0)).collect()
    calls = sorted((float(t), int(n)) for t, n in (line.split() for line in open(log)))
    times = [t for t, _ in calls]
    assert len(out) == 40 and max(n for _, n in calls) <= 2 and all(r.answer in (None, r.text.upper()) for r in out)
    # No stretch of time has more calls than its length allows, besides the first call of each task.
    assert all(j - i + 1 <= callers + (times[j] - times[i]) * limit + 1 for i in range(len(times)) for j in range(i, len(times)))
    assert len(times) > 20 and any(r.answer is None for r in out)


def test_a_call_that_hangs_holds_up_nothing():
    code = "import time\nfrom heronkb.sources import hooks\nprint(hooks.asked(lambda xs: time.sleep(60), ['a', 'b'], 2, 0.0, 0.2))"
    began = time.time()
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=50, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.strip() == "[None, None]" and out.stderr.count("attempt") == 2 and time.time() - began < 40
