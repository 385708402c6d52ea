"""Column expressions: text, money, dates, keys. All stay inside the JVM unless they say otherwise."""
