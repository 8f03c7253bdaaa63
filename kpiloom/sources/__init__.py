from .tables import (FACT_MAPPING, FACT_MAPPING_BRAND, FACT_MAPPING_NO_PROFIT,  # noqa: F401
                     FACT_SQL, TABLES, load_table, sales_fact, tables)
