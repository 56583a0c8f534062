"""Sample rule catalogs shipped with the package (JSON with // comments)."""

import os

RULES_DIR = os.path.dirname(os.path.abspath(__file__))
WAREHOUSE_RULES = os.path.join(RULES_DIR, "warehouse_rules.json")
LAKEHOUSE_RULES = os.path.join(RULES_DIR, "lakehouse_rules.json")
LAKE_SCAN_RULES = os.path.join(RULES_DIR, "lake_scan_rules.json")
