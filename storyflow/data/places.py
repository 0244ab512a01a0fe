"""Fixed values of the gazetteer, repeated names included."""

from __future__ import annotations

#: Places that count as geographic evidence.
PLACES = (
    "Lincolnshire", "Lincoln", "Boston", "Grantham", "Spalding", "Skegness", "Gainsborough", "Sleaford", "Stamford", "Louth", "Horncastle", "Bourne",
    "Market Rasen", "Mablethorpe", "Alford", "Holbeach", "Long Sutton", "Woodhall Spa", "North Hykeham", "South Hykeham", "North Kesteven",
    "South Kesteven", "East Lindsey", "West Lindsey", "South Holland", "Lincoln Crown Court", "Lincoln Magistrates Court", "Boston Magistrates Court",
    "Lincoln Central", "Grantham station", "Sleaford station", "Spalding station", "Skegness station", "Boston station", "Gainsborough station",
    "Stamford station", "Cleethorpes", "Grimsby", "Scunthorpe", "Immingham", "Barton-upon-Humber", "Brigg", "Market Deeping", "The Deepings", "Caistor",
    "Wragby", "Coningsby", "Tattershall", "Metheringham", "Ruskington", "Heckington", "Billinghay", "Mablethorpe and Sutton", "Sutton on Sea",
    "Chapel St Leonards", "Ingoldmells", "Wainfleet", "Burgh le Marsh", "Woodhall", "Tetford", "Spilsby", "Donington", "Crowland", "Deeping St James",
    "Market Deeping", "Pinchbeck", "Gosberton", "Kirton", "Swineshead", "Frampton", "Wrangle", "Sibsey", "Tattershall", "Coningsby", "Navenby",
    "Bracebridge Heath", "Waddington", "Saxilby", "Skellingthorpe", "Welton", "Nettleham", "Dunholme", "Cherry Willingham", "Washingborough", "Bardney",
    "Sutton Bridge", "Gedney", "Moulton", "Crowle", "Epworth", "Kirton in Lindsey", "Barrow upon Humber", "New Holland", "Peaks Lane", "Waltham",
    "Winterton", "Immingham East", "Immingham West", "North Lincolnshire", "North East Lincolnshire", "Isle of Axholme", "Barton", "Barton upon Humber",
    "Barton-upon-Humber", "Ashby", "Bottesford", "Broughton", "Burton upon Stather", "Goxhill", "Haxey", "Keadby", "Messingham", "Roxby", "Scawby",
    "South Killingholme", "Ulceby", "West Butterwick", "Crosby", "Frodingham", "Thealby", "Flixborough", "Gunness", "Alkborough", "Humberston", "Laceby",
    "Healing", "Keelby", "New Waltham", "Tetney", "Great Coates", "Little Coates", "Nunsthorpe", "Freshney", "Haverstoe", "Sidney Sussex", "East Marsh",
    "West Marsh",
)
