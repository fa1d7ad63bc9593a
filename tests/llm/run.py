"""Run corpus queries next to their SQL: python tests/llm/run.py SF_DIR [name ...]"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import compare  # noqa: E402

if __name__ == "__main__":
    import __spark_entry__
    import secframe.catalog as catalog
    catalog.QUERIES, catalog.SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    sys.exit(1 if compare.main(sys.argv[1:]) else 0)
