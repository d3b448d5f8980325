"""Render a bench.py JSON line as a markdown table: python tools/bench_table.py bench.json"""

import json
import sys


def main() -> None:
    d = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
    q = d["queries"]
    print(f"sf {d['sf']}, local[{d['cpus']}], median of {d['repeat']} after one warm-up, noop sink; "
          f"sum {d['value']} s over {len(q)} entries\n")
    print("| key | sec | key | sec | key | sec |")
    print("|---|---|---|---|---|---|")
    items = list(q.items())
    for i in range(0, len(items), 3):
        row = items[i:i + 3] + [("", "")] * (3 - len(items[i:i + 3]))
        print("| " + " | ".join(f"{k} | {v}" for k, v in row) + " |")


if __name__ == "__main__":
    main()
