"""Small input files that the tests write themselves."""

import json

CITIES = ["Aarau", "Bern", "Chur", "Davos", "Elm", "Flims"]


def customers() -> list[dict]:
    """Thirty clean customers: five-letter ids, two-valued MetroArea, nothing missing."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [
        {
            "CustomerID": "K" + "".join(letters[i // 26 ** p % 26] for p in (3, 2, 1, 0)),
            "CompanyName": f"Company {letters[i % 26]}{letters[i // 26]} Trading",
            "ContactName": f"Person {letters[i % 26]} Of {letters[i % 7]}{letters[i // 4]}",
            "ContactTitle": f"Title {letters[i % 13]}{letters[i // 13]}",
            "City": f"{CITIES[i % 6]} {letters[i % 26]}",
            "Region": f"Region {letters[i % 9]}",
            "PostalCode": f"{letters[i % 26]}-{1000 + i} X",
            "Country": f"Land {letters[i % 8]}",
            "Segment": f"Segment {letters[i % 7]}",
            "MetroArea": "True" if i % 3 else "False",
        }
        for i in range(30)
    ]


def orders() -> tuple[list[dict], dict[str, set[int]]]:
    """Orders, and the ids that each of the three routes must get."""
    rows, routes = [], {"accepted": set(), "quarantine": set(), "violation": set()}
    for i in range(43):
        row = {"OrderID": str(10_000 + i), "CustomerID": f"C{i}", "OrderDate": "9/1/2025", "ShippedDate": "10/1/2025",
               "Freight": f"{i}.5", "ShipName": f"name {i}", "ShipRegion": "" if i % 2 else "west"}
        route = "accepted"
        if i % 6 == 1:
            row["CustomerID" if i % 4 == 1 else "ShipName"], route = "", "violation"
        elif i % 3 == 2:
            row["Freight"], route = "-3.25", "quarantine"
        elif i % 7 == 3:
            row["ShippedDate"], route = "8/31/2025", "quarantine"
        rows.append(row)
        routes[route].add(10_000 + i)
    return rows, routes


def employees() -> list[dict]:
    """Nine employees; one birth date is none, one hire date lies in another format."""
    return [
        {"EmployeeID": i, "LastName": f"Family {'ABCDEFGHI'[i - 1]}", "BirthDate": "unknown" if i == 4 else f"1960-0{i}-1{i}",
         "HireDate": f"19{80 + i}/0{i}/2{i % 9}", "City": CITIES[i % 5], "Notes": "speaks, reads" if i % 2 else "writes"}
        for i in range(1, 10)
    ]


def as_csv(rows: list[dict]) -> str:
    quoted = lambda v: f'"{v}"' if "," in str(v) else str(v)
    return "\n".join([",".join(rows[0]), *(",".join(quoted(v) for v in r.values()) for r in rows)]) + "\n"


CONTENTS = {
    "customers": ("customers.csv", lambda: as_csv(customers())),
    "customers_json": ("customers.json", lambda: json.dumps(customers(), indent=2)),
    "orders": ("orders.csv", lambda: as_csv(orders()[0])),
    "employees": ("employees.csv", lambda: as_csv(employees())),
    "people": ("people.csv", lambda: "name,age,email,city\n" + "".join(
        f"Name {c},{20 + i},{c.lower()}{i}@example.com,{CITIES[i]}\n" for i, c in enumerate("ABCDE"))),
}
