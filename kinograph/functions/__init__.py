"""Part of kinograph."""
