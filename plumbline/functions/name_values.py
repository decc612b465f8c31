"""Fixed values about names of tables and columns: plain data, read by ``names``."""

#: Abbreviated words of business column names and what they stand for.
ABBREVIATIONS = {
    "dev": "device", "sys": "system", "ent": "enterprise", "org": "organization", "loc": "location", "cfg": "config", "conf": "config", "attr": "attribute",
    "dept": "department", "emp": "employee", "cust": "customer", "prod": "product", "mat": "material", "wh": "warehouse", "equip": "equipment", "eqp": "equipment",
    "addr": "address", "msg": "message", "pkg": "package", "cat": "category", "grp": "group", "usr": "user", "acct": "account", "proj": "project", "std": "standard",
}
#: Words too general to tell, on their own, what a key identifies.
GENERIC = {"status", "number", "amount", "remark", "detail", "record", "values", "result", "source", "target"}
#: Ends of key columns, and pairs of them that identify things in different ways.
KINDS = ("id", "code", "key", "no", "num")
UNLIKE = ({"id", "no"}, {"id", "code"})
#: Words that say what part a row plays: whether its own table is meant, and words of tables of those who can play it.
ROLES = {
    "manager": (True, ("employee", "staff", "person", "user")), "reports to": (True, ("employee", "staff", "person", "user")), "supervisor": (True, ("employee", "staff", "person", "user")),
    "mgr": (True, ("employee", "staff", "person", "user")), "boss": (True, ("employee", "staff", "person")),
    "parent": (True, ()), "predecessor": (True, ()), "successor": (True, ()), "prior": (True, ()), "prev": (True, ()), "next": (True, ()),
}
#: First words of tables that name a warehouse layer, last words that name a copy, and tables that list days.
LAYERS = {"fact", "dim", "dws", "dwd", "ods", "ads", "dm"}
COPIES = {"bak", "backup", "offline", "tmp", "old", "copy", "hist"}
CALENDARS = ({"calendar"}, {"date", "dim"})
