"""A small shop with the awkward cases: repeated lines, orders without lines, unknown stores, missing flags."""

from __future__ import annotations

from shelfline import schemas
from shelfline.plans import silver
from shelfline.plans.semantic import Model

PRODUCTS = [
    ("P1", "Red Jacket", "Polyester", 100.0, "red", "BOSS"),
    ("P2", "Blue Shoe", "Leather", 50.0, "blue", "HUGO"),
    ("P3", "Green Shirt", "Cotton", 20.0, "green", None),
    ("P4", "Red Jacket", "Cotton", 80.0, "black", "BOSS"),
]
CATEGORIES = [("P1", "jackets"), ("P2", "shoes"), ("P3", "tshirts"), ("P3", ""), ("P4", "jackets")]
ORDERS = [
    ("O20240101-00001", "U1", "Cologne", True, "WELCOME5"),
    ("O20240101-00002", "U1", "Online", False, None),
    ("O20240102-00003", "U2", "Paris", None, None),
    ("O20240102-00004", None, "Munich", True, "VIP5"),
    ("O20241399-00005", "U3", None, False, None),
    ("X-1", "U3", "Online", False, None),
    ("O20241224-00006", "U4", "Hamburg", False, None),
]
ITEMS = [
    ("O20240101-00001", "P1", 2, "red"),
    ("O20240101-00001", "P1", 1, "red"),
    ("O20240101-00001", "P2", 1, "blue"),
    ("O20240101-00002", "P1", 1, "red"),
    ("O20240101-00002", "P2", 3, "blue"),
    ("O20240102-00003", "P2", 1, "blue"),
    ("O20240102-00004", "P4", 1, "black"),
    ("X-1", "P4", 2, "black"),
    ("X-1", "P1", 1, "red"),
]
INVENTORY = [
    ("P1", "Cologne", "XL", 3), ("P1", "Cologne", "S", 4), ("P1", "Munich", "S", 5),
    ("P2", "Cologne", "46", 1), ("P2", "Cologne", "39", 2), ("P4", "Munich", "M", 6),
]


class Shop:
    def __init__(self, spark):
        self.products = spark.createDataFrame(PRODUCTS, schemas.PRODUCTS)
        self.cats = spark.createDataFrame(CATEGORIES, schemas.PRODUCT_CATEGORIES)
        self.orders = spark.createDataFrame(ORDERS, schemas.ORDERS)
        self.items = spark.createDataFrame(ITEMS, schemas.ORDER_ITEMS)
        self.inventory = spark.createDataFrame(INVENTORY, schemas.PRODUCT_INVENTORY)
        self.one_category = self.cats.where("category <> ''")
        self.kept_items = silver.clean_items(self.items)
        self.sales = silver.fact_sales_item(self.kept_items, self.products, self.one_category)
        self.summary = silver.fact_basket_summary(silver.clean_orders(self.orders), self.sales)
        self.stores = silver.dim_store(self.orders)
        self.dims = silver.dim_product(self.products, self.one_category)
        self.model = Model(self.dims, self.stores, silver.dim_date(self.orders), self.sales, self.summary)

    @property
    def bronze(self):
        return {
            "products": self.products, "product_categories": self.cats, "orders": self.orders,
            "order_items": self.items, "product_inventory": self.inventory,
        }
