"""sparkloom: document, vector and relational analytics on PySpark."""
