"""Print the oracle comparison of all or some queries: run_checks.py [sf_dir] [name ...]."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newswatch.plans import registry  # noqa: E402
from newswatch.session import build_session  # noqa: E402
from tests.oracle_check import compare, connect  # noqa: E402


def main(sf_dir: str, names: list[str]) -> None:
    spark = build_session("checks", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, bad = registry.oracle_sql(), []
    for name, query in registry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                rows, problems = compare(df, con, oracle[name])
            else:
                rows, problems = df.count(), []
        except Exception as error:  # noqa: BLE001 - report and go on
            rows, problems = -1, [str(error)[:1500], traceback.format_exc().splitlines()[-1][:300]]
        mark = "FAIL" if problems else "ok  " if name in oracle else "rows"
        print(f"{mark} {name} rows={rows} {time.time() - start:.2f}s", flush=True)
        for problem in problems:
            print("    ", problem)
        if problems:
            bad.append(name)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
